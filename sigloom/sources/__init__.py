"""Scans, intake and sinks."""
