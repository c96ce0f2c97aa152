"""lodestrata: a Spark-native analytics engine for property data and large text corpora."""
