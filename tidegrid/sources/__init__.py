"""sources of the metrics engine."""
