"""Column expressions and small aggregations shared by the operators."""
