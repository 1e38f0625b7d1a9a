"""Relational operators on canonical records and pairs."""
