"""Document-extraction evaluation and corpus processing on Spark."""
