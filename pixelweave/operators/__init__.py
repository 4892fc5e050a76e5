"""Operators over pixel relations: DataFrame in, DataFrame out, lazily."""
