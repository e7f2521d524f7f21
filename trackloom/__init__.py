"""trackloom: Spark-native analytics over location tracks."""
