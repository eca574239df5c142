"""Column expressions and the fixed values they are built from."""
