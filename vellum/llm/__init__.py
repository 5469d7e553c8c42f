"""Operators of a training-data pipeline, each a plain Spark job over whole tables."""
