"""Column expressions: objectives, metrics, links, order keys."""
