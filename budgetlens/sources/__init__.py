"""Scans and sinks: the test-data stand-in, delimited text, Parquet hand-off tables."""
