"""Sequence read mapping and its analysis as Spark DataFrames."""
