"""Grid-to-regions analytics on Spark: every operator takes and returns DataFrames."""
