"""sigloom: a Spark-native analytics engine for long-format signals."""

__version__ = "0.1.0"
