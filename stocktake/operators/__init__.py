"""Operators on inventories, from DataFrames to DataFrames."""
