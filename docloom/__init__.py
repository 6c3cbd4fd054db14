"""docloom: document analytics and data preparation on Spark DataFrames."""
