"""quire: a PySpark-native engine for document collections and bibliographic data."""
