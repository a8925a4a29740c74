"""Operators for training-data pipelines (documents, pages, labels)."""
