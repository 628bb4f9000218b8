"""Column expressions and table primitives the operators are composed of."""
