"""Interval annotation, detection scoring and label-loop analytics on Spark DataFrames."""

__version__ = "0.1.0"
