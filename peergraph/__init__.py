"""Graph-and-cohort analytics as PySpark DataFrame functions."""

__version__ = "0.2.0"
