"""Evidence retrieval and text analytics on Spark."""
