"""Operators of the site index; each takes and returns DataFrames."""
