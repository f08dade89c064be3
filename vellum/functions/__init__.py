"""Column-level functions: tokenising, record conversion, encryption."""
