"""PySpark-native text mining, annotation, reranking and evaluation."""
