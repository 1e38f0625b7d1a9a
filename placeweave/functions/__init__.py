"""Column expressions: coordinates, tiles, text, vectors, phones."""
