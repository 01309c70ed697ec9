"""Readers, writers, file checks and stored results."""
