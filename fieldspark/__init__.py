"""Field-inspection analytics on Spark DataFrames."""
