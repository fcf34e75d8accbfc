"""Whole jobs: detect, report, redact, restore."""
