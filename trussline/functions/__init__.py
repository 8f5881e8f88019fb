"""Column expressions: text, geometry, identifiers and storeys."""
