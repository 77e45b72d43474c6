"""Relational operators over the curated tables."""
