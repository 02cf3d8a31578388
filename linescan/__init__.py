"""Search of large archives of compressed log lines as Spark jobs."""
