"""Operators for preparing large text corpora: filters, deduplication, mixing, token output."""
