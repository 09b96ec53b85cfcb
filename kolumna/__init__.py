"""kolumna: ordered, columnar, time-series analytics on Spark DataFrames."""
