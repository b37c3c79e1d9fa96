"""Registered queries (one per SURVEY section-2 operator) and their SQL oracles."""
