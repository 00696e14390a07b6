"""Readers: where the tables come from."""
