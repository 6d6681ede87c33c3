"""Listing consolidation jobs on Spark: DataFrame in, DataFrame out."""
