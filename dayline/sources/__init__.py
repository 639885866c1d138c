"""Readers and writers of curve tables."""
