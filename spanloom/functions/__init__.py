"""Column expressions: names, timestamps, units, hashing and statistics."""
