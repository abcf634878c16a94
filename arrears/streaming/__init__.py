"""Incremental (Structured Streaming) forms of batch operators: the landing
of source relations with lineage, and the daily operator activity count."""
