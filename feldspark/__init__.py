"""Feature preparation for tabular data on Spark: fitted on the training split, applied as plain projections."""
