"""Column-level helpers; everything stays inside built-in Spark expressions."""
