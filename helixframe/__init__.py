"""helixframe: a PySpark-native engine for labelled sequence analytics."""

__version__ = "0.1.0"
