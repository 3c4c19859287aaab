"""seqspark: DataFrame-in, DataFrame-out analytics for sequence tables on Spark."""
