"""Column builders: each takes and returns columns, so Catalyst sees through them."""
