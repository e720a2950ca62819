"""Scalar functions as Column builders, and the same functions as SQL text for the oracle."""
