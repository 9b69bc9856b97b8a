"""quaestor: a PySpark-native engine for document question answering and its evaluation."""

__version__ = "0.1.0"
