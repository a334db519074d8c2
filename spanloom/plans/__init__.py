"""Analyses composed from operators, and the queries registered on them."""
