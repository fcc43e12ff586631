"""Structured Streaming forms of operators (an extension: the methods themselves are for finite recordings)."""
