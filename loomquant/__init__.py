"""A Spark-native engine for quantitative research."""
