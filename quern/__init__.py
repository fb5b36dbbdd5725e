"""Search and community analytics on PySpark: plain functions from DataFrames to a DataFrame."""
