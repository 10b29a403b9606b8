"""Column builders; every one stays inside native Spark expressions."""
