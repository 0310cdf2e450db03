"""A PySpark-native analytics engine: DataFrames, Spark SQL and Catalyst do the work."""
