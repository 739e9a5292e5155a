"""Process discovery and simulation on Spark."""
