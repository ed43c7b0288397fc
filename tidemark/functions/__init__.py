"""Column expressions: exact time arithmetic, entity keys, comparisons."""
