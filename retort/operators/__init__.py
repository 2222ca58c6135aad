"""Operators: functions from DataFrames to DataFrames, key columns by name."""
