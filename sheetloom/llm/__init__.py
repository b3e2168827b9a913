"""Operators of a training-data pipeline: deduplication, scoring, filtering and tokenisation of documents."""
