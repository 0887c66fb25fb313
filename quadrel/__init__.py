"""quadrel: large annotated matrices and record tables as Spark DataFrames."""

__version__ = "0.1.0"
