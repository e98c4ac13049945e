"""Readers and writers: archives, markup, documents, people, staged tables."""
