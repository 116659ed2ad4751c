"""Column functions: predicates, metrics, features, vectors and text."""
