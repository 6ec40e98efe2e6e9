"""Column expressions: predicates, interval ends, partial dates, labels and links."""
