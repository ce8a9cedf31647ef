"""Spark jobs for monthly operations reporting and data quality."""
