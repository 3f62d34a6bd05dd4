"""Readers of listing files and writers of results."""
