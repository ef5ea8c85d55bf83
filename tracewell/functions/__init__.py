"""Queries per function family."""
