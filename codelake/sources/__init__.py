"""Capturing trees of files, and the tables of repositories and snapshots."""
