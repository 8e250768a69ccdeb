"""A Spark-native engine for curating text corpora and evaluating summaries of them."""
