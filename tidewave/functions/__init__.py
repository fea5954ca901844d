"""Column-level functions; all built from Spark expressions."""
