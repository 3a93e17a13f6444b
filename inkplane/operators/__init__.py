"""Operators: DataFrame in, DataFrame out, for any table with the named columns."""
