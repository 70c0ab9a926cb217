"""Readers, writers, formats and settings."""
