"""Composed curation pipelines, the registered query catalog and the DuckDB
oracle SQL fragments.
"""
