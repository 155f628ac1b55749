"""Column-level functions: all of them build native Spark expressions."""
