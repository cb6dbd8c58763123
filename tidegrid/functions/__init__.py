"""functions of the metrics engine."""
