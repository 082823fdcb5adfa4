"""Queries that run a stream to its end."""

from __future__ import annotations

import uuid

from equarry.session import shared_folder
from equarry.sources.sinks import read_deltas
from equarry.sources.tables import table
from equarry.streaming.ingest import ingest


def stream_ingest_dedup(spark, folder):
    """Equations through the file stream into a keyed table; one row a stored key, which one depends on the files' order."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, folder, "equations").select("row_id", "source_id", "eq_id", "ingested_at")
    rows.write.parquet(f"{base}/in")
    ingest(spark, f"{base}/in", rows.schema, f"{base}/out", f"{base}/state", ["source_id", "eq_id"], files_per_batch=1000)
    return read_deltas(spark, f"{base}/out").select("source_id", "eq_id")


QUERIES = {"stream_ingest_dedup": stream_ingest_dedup}
SQL = {"stream_ingest_dedup": "select distinct source_id, eq_id from equations"}
