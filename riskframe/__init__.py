"""riskframe: score analytics on Spark DataFrames of any size."""

__version__ = "0.1.0"
