"""Profiles over streams."""
