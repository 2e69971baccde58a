"""Column functions. Every function takes and returns ``Column`` values."""
