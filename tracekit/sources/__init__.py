"""Readers and writers (JSON lines, Parquet) and the input tables with the
derived record views the registered queries run on.
"""
