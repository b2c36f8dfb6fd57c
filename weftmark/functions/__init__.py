"""Column-level helpers (native Spark SQL expressions)."""
