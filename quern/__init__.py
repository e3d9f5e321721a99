"""quern: a Spark-native engine for preparing text corpora for language-model training."""
