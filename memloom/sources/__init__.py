"""Readers and writers of exports, archives and snapshots."""
