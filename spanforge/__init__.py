"""spanforge: retrieval-evaluation analytics as DataFrame-to-DataFrame operators on Spark."""
