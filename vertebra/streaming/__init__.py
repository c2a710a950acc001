"""Streams into and out of graphs."""
