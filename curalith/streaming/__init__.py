"""Operators over streams of files."""
