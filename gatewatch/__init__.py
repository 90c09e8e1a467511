"""Web-log security analytics on Spark."""
