"""Query plans: stand-in tables over the supplied parquet and the query catalogue."""
