"""Scanning as a stream."""
