"""Readers and writers for requests, dictionaries, training items and model tables."""
