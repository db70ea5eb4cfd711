"""Readers: event tables, and the binary files of a recording session."""
