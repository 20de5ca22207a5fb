"""Readers and writers of the engine."""
