"""Operators for preparing language-model training data, built on Spark DataFrames.

Each module holds one operator with a general interface over any DataFrame.
``queries`` binds them to the test tables. Nothing outside this package imports it.
"""
