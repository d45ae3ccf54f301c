"""Readers and writers of user files."""
