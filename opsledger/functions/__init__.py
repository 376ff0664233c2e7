"""Column expressions: all built from Spark's own functions, none from Python code on rows."""
