"""Provenance-audit analytics over Spark DataFrames."""
