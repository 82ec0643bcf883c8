"""Scalar Column functions (native Spark expressions, no Python UDFs)."""
