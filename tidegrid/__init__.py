"""A metrics engine on Spark: labelled time series, range queries over a step grid, rollups and ingest."""
