"""Web-acquisition analytics on Spark."""
