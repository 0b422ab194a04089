"""lectern: a PySpark-native engine for turning books and web text into speech-ready data."""

__version__ = "0.1.0"
