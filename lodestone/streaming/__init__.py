"""Streams of usage records and of rows to profile."""
