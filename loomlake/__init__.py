"""loomlake: hybrid retrieval and note analytics as declarative Spark plans."""
