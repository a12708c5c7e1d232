"""Readers of the raw layers and writers of results."""
