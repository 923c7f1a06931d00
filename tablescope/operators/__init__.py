"""Profiling, quality, descriptive and modelling operators: DataFrame in, DataFrame out."""
