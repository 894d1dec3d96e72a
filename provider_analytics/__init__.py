"""Set-at-a-time analytics for directories of professionals, on Spark DataFrames."""

__version__ = "0.1.0"
