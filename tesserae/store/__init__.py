"""Append-only storage behind a commit log."""
