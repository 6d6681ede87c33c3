"""Jobs: DataFrame in, DataFrame out."""
