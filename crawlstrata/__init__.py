"""Web-archive capture analytics on Spark."""
