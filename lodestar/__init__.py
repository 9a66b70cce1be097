"""lodestar: a PySpark-native analytics engine built on the DataFrame, SQL and streaming APIs."""
