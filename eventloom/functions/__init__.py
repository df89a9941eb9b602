"""Column expressions. Everything here stays in built-in functions."""
