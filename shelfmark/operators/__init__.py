"""Relational operators: DataFrame(s) and parameters in, DataFrame out."""
