"""Readers and writers of fact tables."""
