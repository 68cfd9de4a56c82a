"""Spark-first analytics for comparative and population genomics tables."""
