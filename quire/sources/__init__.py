"""Readers and listings."""
