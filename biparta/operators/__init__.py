"""Relational and graph operators; every one takes and returns DataFrames."""
