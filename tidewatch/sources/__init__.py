"""Readers and the replay source."""
