"""Operators that prepare text corpora for model training.

Nothing outside this folder imports it. Every operator takes and returns
DataFrames; ``queries`` holds the thin contract queries over them.
"""
