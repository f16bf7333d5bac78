"""sparkloom: a Spark-first lexicon, graph and usage-series analytics library.

Operators are functions from DataFrames to DataFrames; nothing here starts a
session or collects rows.  See README.md for the map of the package.
"""
