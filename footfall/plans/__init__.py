"""Whole jobs composed of operators, and the queries over the test tables."""
