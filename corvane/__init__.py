"""corvane: a Spark-native engine for building, cleaning, searching and measuring text corpora."""

__version__ = "0.1.0"
