"""The same jobs on streams of files."""
