"""Readers and parsers that turn landed payloads into tables."""
