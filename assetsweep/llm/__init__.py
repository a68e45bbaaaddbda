"""Operators of a training-data pipeline (chat formatting, WARC bundles, near-duplicate joins, ...)."""
