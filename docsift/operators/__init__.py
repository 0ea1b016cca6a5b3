"""Relational and vector operators over document / vector DataFrames."""
