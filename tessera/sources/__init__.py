"""Readers, writers and dataset registry."""
