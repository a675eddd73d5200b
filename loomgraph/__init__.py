"""loomgraph: documents to clean text, chunks, graphs and retrieval, as Spark DataFrame jobs."""
