"""Column expressions: type names, defaults, statement text."""
