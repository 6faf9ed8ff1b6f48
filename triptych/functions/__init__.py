"""Column expressions: no shuffle, no Python, usable in any select."""
