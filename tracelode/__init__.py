"""Spark-first engine for matching claims about posts with archived captures."""

__version__ = "0.1.0"
