"""Joins, clustering, scoring, selection, review and state operators."""
