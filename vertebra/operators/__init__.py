"""Graph operators: each takes and returns DataFrames or columns and keeps no state."""
