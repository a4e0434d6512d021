"""Operators of a training-data pipeline, built on Spark DataFrames.

Nothing outside this folder imports it; `queries` holds the registered queries.
"""
