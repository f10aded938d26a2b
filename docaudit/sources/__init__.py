"""Readers and writers: packages, pages, JSON lines, manifests, fact tables."""
