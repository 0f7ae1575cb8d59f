"""Columnar table analytics on Spark DataFrames."""
