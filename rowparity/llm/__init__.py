"""Operators for preparing training text, on Spark DataFrames.

Nothing else in the library imports this subpackage.  Modules import their
dependencies directly; the guard for a missing subpackage is in
``__spark_entry__.py`` alone.
"""
