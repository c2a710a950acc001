"""Registered queries over the shared tables, and the SQL that they must equal."""
