"""Whole runs and registered queries."""
