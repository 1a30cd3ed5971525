"""Batch and streaming analytics over saved web links, on PySpark DataFrames."""
