"""Shared plan shapes: skew-safe joins, bounded ranking, quantiles, whole reports."""
