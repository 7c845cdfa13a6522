"""tidemark: temporal corpus analytics on Spark."""
