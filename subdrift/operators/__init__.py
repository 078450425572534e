"""Drift checks, threshold tables and monitor operators."""
