"""Failure-risk analytics for machine-sensor tables and streams, on Spark."""
