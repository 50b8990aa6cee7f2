"""Document retrieval and evidence analytics on Spark."""
