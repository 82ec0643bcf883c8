"""Table sources: parquet scans with explicit columns."""
