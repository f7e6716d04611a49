"""Sources and sinks: Parquet tables, CSV ingest, landing and result tables."""
