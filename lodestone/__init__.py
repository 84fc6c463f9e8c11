"""Lodestone: analytics and data mining on PySpark DataFrames."""
