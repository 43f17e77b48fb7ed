"""Column-level functions: text, tokens, predicates, vectors."""
