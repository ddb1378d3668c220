"""Structured Streaming forms of the tailing operators; each has a batch twin in operators."""
