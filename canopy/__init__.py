"""canopy: land-cover and phenology analytics on Spark DataFrames."""
