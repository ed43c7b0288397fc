"""Operators on DataFrames: features, as-of joins, cohorts, quality gates, entity candidates, metrics, parity."""
