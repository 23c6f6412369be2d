"""Readers and writers for the file layouts the analyses use."""
