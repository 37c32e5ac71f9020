"""quarry: document, graph and vector analytics written as Spark DataFrame jobs."""
