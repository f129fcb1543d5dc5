"""A Spark-native analytics engine for catalogs of people, works and releases."""
