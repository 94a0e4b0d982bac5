"""Event-analytics operators on Spark DataFrames."""
