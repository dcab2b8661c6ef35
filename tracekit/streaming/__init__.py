"""Incremental curation of arriving trace files with Structured Streaming.
"""
