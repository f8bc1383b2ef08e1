"""Readers and writers of snapshots."""
