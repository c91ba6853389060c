"""rowloom: dataset preparation on Spark DataFrames."""
