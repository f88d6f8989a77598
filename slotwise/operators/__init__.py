"""Scheduling operators: DataFrame in, DataFrame out."""
