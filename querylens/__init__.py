"""querylens: SQL text analysis and corpus processing as Spark jobs."""
