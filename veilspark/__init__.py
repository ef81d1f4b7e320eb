"""Masking, referential subsetting, validation and dumps of relational data on Spark."""

__version__ = "0.1.0"
