"""Spark-native orthography analytics: corpora, lexicons, spelling checks and their measures as DataFrame plans."""

__version__ = "0.1.0"
