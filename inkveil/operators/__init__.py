"""Operators over tables of documents and spans."""
