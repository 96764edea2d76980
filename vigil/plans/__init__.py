"""Compositions of operators, the query registry and its SQL oracles."""
