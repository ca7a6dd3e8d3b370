"""Log normalisation engine built from Spark DataFrame operations."""
