"""Relational and dataset operators."""
