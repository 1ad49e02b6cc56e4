"""Security findings at fleet scale, written as Spark DataFrame and streaming jobs."""
