from stratiform.streaming.dedup import deduplicated, keep_first, keep_newest, read_first, read_newest
from stratiform.streaming.enrich import Range, enrich, enriched, late_rows, read_enriched
from stratiform.streaming.ingest import envelope_stream, ingest_flights, ingest_records
from stratiform.streaming.upsert import upsert_cells

__all__ = ["Range", "deduplicated", "enrich", "enriched", "envelope_stream", "ingest_flights", "ingest_records", "keep_first", "keep_newest", "late_rows", "read_enriched", "read_first", "read_newest", "upsert_cells"]
