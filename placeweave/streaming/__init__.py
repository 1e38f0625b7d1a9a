"""Incremental upkeep of word indexes."""
