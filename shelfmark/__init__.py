"""Document-corpus analytics as plain functions over Spark DataFrames."""
