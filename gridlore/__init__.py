"""Point-in-time contest and event analytics on Spark."""
