"""Operators for training-data pipelines: extraction, filtering, near duplicates, scoring, redaction and packing."""
