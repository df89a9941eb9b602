"""Scans, sinks and parsers of listings."""
