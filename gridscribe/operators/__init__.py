"""Operators over table sets, passages, runs and vectors."""
