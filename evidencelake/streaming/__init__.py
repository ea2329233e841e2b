"""Structured Streaming forms of the file intake and of the hourly log counts."""
