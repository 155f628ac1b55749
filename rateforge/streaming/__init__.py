"""Scoring over unbounded tables."""
