"""Operators from text to tokens and back, on DataFrames."""
