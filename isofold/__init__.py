"""Scalar-field topology and ensemble analytics on Spark DataFrames."""

__version__ = "0.1.0"
