"""Relational, window, aggregate and spatial operators: DataFrame in, DataFrame out."""
