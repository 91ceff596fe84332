"""A Spark-native engine for curating large sets of images and other items."""

__version__ = "0.1.0"
