"""lorebase: a Spark-native analytics engine for conversation archives and the knowledge graphs built from them."""
