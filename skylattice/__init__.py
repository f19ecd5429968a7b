"""Spark-native analytics for probability maps on the sphere.

A map is an ordinary DataFrame with one row per multi-resolution pixel; every
capability is a function from DataFrames to DataFrames.  Nothing is imported
eagerly here, so that executors load only the modules that a task needs.
"""

__version__ = "0.1.0"
