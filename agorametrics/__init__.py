"""Chat-community analytics as PySpark DataFrame builders."""

__version__ = "0.1.0"
