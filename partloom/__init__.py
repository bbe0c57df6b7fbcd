"""Parts-catalog, inventory and invoicing analytics on Spark DataFrames."""
