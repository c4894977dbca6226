"""Relational, window and analytic operators."""
