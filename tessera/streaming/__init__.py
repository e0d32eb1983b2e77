"""Measurements as they arrive."""
