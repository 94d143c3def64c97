"""larkspur: retrieval, ranking and corpus analytics as Spark DataFrame plans."""
