"""lociframe: molecule-level variant evidence on Spark DataFrames."""
