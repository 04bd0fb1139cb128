"""Customer-panel analytics on Spark: labels, features, drift, sampling, profit curves."""
