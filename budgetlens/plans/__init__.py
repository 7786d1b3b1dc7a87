"""Registered queries: each pairs a Spark plan over the test tables with a DuckDB oracle."""
