"""Land-ownership analytics on Spark."""
