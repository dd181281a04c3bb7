"""citeloom: a Spark-native engine for bibliographic corpora and training-data pipelines."""
