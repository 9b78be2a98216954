"""Operators over the customer table: DataFrame in, DataFrame out."""
