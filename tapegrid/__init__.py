"""tapegrid: minute-bar and event-market analytics on Spark DataFrames."""
