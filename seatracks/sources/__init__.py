"""Readers, writers and test tracks."""
