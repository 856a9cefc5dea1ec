"""Readers of fact tables."""
