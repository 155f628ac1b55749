"""Relational operators over review, split and prediction tables."""
