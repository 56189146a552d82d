"""Column-level helpers; everything stays in built-in expressions."""
