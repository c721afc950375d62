"""Text diagnostics and corpus preparation on Spark."""
