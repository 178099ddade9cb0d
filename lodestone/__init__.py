"""lodestone: dataset profiling, matching, search and evaluation as Spark jobs."""
