"""Operators, DataFrame in and DataFrame out, by kind."""
