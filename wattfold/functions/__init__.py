"""Column-level helpers: everything here takes and returns Columns."""
