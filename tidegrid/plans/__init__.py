"""plans of the metrics engine."""
