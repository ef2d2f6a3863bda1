"""Framewright: a Spark-native library for the data side of image-model inference."""

__version__ = "0.1.0"
