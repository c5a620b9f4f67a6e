"""Deterministic document hygiene over DataFrames."""

__version__ = "0.1.0"
