"""Fixture views and registered queries."""
