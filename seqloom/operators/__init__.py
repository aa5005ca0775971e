"""Operators: functions from DataFrames of records to DataFrames."""
