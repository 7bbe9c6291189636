"""Column expressions: text, clinical recodes, special functions, age curve, rates."""
