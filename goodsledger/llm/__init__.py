"""Operators of a training-data pipeline: packing, filters, deduplication, models, tokenization, scans."""
