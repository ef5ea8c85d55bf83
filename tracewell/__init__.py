"""Warehouse lineage and query analytics as Spark jobs."""
