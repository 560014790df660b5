"""siftlake: hybrid retrieval and its operational analytics as Spark DataFrame plans."""
