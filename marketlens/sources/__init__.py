"""Sources and sinks: supplied-table adapter, CSV ingest, layered Parquet warehouse."""
