"""Registered queries, their SQL twins and end-to-end compositions."""
