"""Readers and writers of tables, passages, questions, labels, runs and metadata."""
