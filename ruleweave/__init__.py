"""Rule-based relational analytics on Spark DataFrames."""
