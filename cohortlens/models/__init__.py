"""Training, scoring and searching tree models with Spark ML."""
