"""Spark jobs that measure how trustworthy cited sources are, and prepare their texts."""
