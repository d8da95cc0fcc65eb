"""Spark-first inventory, redaction and corpus engine."""
