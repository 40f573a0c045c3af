"""gridlark: a Spark-native engine for exploring, querying and preparing tabular data."""

__version__ = "0.1.0"
