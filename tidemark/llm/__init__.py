"""Operators for preparing language-model training data with Spark.

Every operator takes and returns DataFrames; ``queries`` binds ten of them to the test tables.
"""
