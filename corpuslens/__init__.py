"""corpuslens: document-collection analytics as Spark DataFrame jobs."""
