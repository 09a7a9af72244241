"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, never changes its input, and reads only the columns named in its
arguments, so extra columns (whatever their names) pass by unseen.
"""
