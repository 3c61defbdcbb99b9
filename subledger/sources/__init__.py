"""Readers, writers and derived sources."""
