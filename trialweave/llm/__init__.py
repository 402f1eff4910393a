"""Operators of a training-data pipeline: quality, deduplication, decontamination, PII, packing and scoring."""
