"""Spark-first toolkit for sports-table integration, model preparation and corpus checks."""
