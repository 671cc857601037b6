"""Relational and per-date operators."""
