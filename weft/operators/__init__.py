"""Operators: DataFrame to DataFrame, with explicit keys and tie-breakers."""
