"""A PySpark-native engine for document libraries, evidence retrieval and their logs."""
