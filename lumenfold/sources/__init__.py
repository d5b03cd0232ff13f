"""Readers: repaired CSV, office files, JSON lines, uploads."""
