"""Column expressions: text, check digits, masks, spans of patterns."""
