"""Quality analytics for web-content extraction, written as Spark DataFrame jobs."""
