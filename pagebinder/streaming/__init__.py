"""Structured streams; each has a batch twin among the operators."""
