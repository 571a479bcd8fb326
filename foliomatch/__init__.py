"""Document comparison and corpus preparation as lazy Spark DataFrame plans."""
