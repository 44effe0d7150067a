"""Compositions: steppers, runners and the registered queries."""
