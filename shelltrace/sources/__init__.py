"""Readers and writers for logs, transcripts, sessions and reports."""
