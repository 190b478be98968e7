"""Cadenza: a PySpark-native engine for curating corpora of timed segments.

Every operator takes DataFrames and returns DataFrames; nothing is executed until the
caller asks for an action.  See README.md for the layout.
"""
