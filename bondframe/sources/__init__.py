"""Readers and writers of molecule tables."""
