"""Operators over particle tables."""
