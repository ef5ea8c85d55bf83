"""Operators for preparing training data: deduplication, filters, scans and formatting."""
