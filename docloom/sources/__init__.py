"""Readers and writers of the stored tables and of raw documents."""
