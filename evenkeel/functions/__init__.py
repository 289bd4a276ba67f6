"""Column functions: text and decision grammar, exact arithmetic, hashing."""
