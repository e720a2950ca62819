"""Whole plans: serialization strategies, staging and the queries' SQL."""
