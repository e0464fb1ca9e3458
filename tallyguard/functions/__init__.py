"""Column expressions: JSON text, identity hashes, payload shapes."""
