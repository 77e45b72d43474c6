"""Spark jobs that turn web snapshots into curated tables."""
