"""Training-data operators on Spark."""
