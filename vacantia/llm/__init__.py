"""Operators that large training-text pipelines need, as Spark jobs."""
