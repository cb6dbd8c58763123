"""operators of the metrics engine."""
