"""colquery: strict integer analytics on Spark, declared with the DataFrame API."""
