"""Grid generators, readers and writers."""
