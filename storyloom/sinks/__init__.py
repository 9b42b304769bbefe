"""Sinks of what a run decides."""
