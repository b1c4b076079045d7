"""Column builders: text and hyperbolic geometry."""
