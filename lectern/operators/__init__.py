"""Relational, retrieval and analytic operators: DataFrame in, DataFrame out."""
