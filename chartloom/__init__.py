"""Clinical-note extraction and corpus analytics as plain Spark DataFrame operations."""
