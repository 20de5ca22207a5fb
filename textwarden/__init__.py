"""Sensitive-text scanning, dataset auditing and classifier evaluation on Spark DataFrames."""
