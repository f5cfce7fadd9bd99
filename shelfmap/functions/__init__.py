"""Column-expression builders: predicates, scalar functions, array math."""
