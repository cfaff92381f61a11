"""Scans: landed files or tables -> DataFrames."""
