"""Readers, generators and writers of particle and grid relations."""
