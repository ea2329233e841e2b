"""Readers and writers: event files, typed tables, versioned stores and logs."""
