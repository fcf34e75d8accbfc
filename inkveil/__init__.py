"""A PySpark engine that finds, scores, masks, pseudonymises and restores sensitive text in large collections of documents."""
