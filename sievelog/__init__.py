"""Log templates, run comparison and related analytics on Spark DataFrames."""

__version__ = "0.1.0"
