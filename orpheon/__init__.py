"""orpheon: a PySpark-native engine for evaluating embeddings, labels and sequences at scale."""
