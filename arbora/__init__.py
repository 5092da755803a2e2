"""arbora: code analytics and property graphs on Spark DataFrames."""

__version__ = "0.1.0"
