"""quern: a PySpark-native engine for document retrieval and its analytics."""
