"""Operators: every one takes DataFrames and gives a DataFrame; nothing runs before the caller's action."""
