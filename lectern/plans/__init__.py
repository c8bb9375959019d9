"""Registered queries: the operators applied to stand-in views of the test tables, with SQL oracles."""
