"""Operators for training-data pipelines: scoring, filters, deduplication, decontamination, mixing."""
