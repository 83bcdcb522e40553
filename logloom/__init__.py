"""logloom: perimeter logs to validated events and SQL over them, on Spark DataFrames."""
