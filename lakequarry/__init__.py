"""Lakequarry: document and record analytics on Spark DataFrames."""
