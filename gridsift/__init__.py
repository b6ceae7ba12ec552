"""Search, query and reshape tables found in documents, on Spark."""
