"""Readers of text, Word files, rules and settings."""
