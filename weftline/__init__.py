"""weftline: a Spark-native engine for record matching, ranking and evaluation."""
