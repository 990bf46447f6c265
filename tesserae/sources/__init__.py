"""Readers and writers: logical snapshots, retrieval suites, wiki pages, and documents as nodes."""
