"""stylomill: a PySpark-native engine for stylometric text classification analytics."""
