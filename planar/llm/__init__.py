"""Operators for preparing text corpora: deduplication, filters, scoring, mixing."""
