"""docloom: a PySpark-native engine for document analytics and hybrid retrieval."""

__version__ = "0.1.0"
