"""Readers, writers and the parsers of mail and HTML."""
