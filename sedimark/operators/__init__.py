"""Relational operators. Each takes DataFrames and returns a lazy DataFrame unless its docstring says that it stages."""
