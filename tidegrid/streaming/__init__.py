"""streaming of the metrics engine."""
