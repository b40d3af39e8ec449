"""Structured Streaming form of the daily source load (the source system has no
stream operators; only its ODS snapshot load is re-expressed incrementally)."""

from marketlens.streaming.ods_ingest import start_ods_ingest

__all__ = ["start_ods_ingest"]
