"""Column expressions: no action, no join, usable in any select."""
