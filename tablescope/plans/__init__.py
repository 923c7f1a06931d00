"""Whole profiles, put together from the operators."""
