"""Functions on values: collation keys."""
