"""Readers, writers and keyed storage."""
