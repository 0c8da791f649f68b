"""Relational operators of the usage engine (DataFrame in, DataFrame out)."""
