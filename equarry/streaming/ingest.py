"""New files to a keyed table, and batches of references to the orphan tracker; a restarted run goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from equarry.operators.corpus import new_rows
from equarry.operators.orphans import OrphanTracker, keyed, references
from equarry.sources.sinks import read_deltas, write_delta


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: list[str], order: str = "row_id", files_per_batch: int = 1) -> None:
    """Merge all files of source not seen before into the growing table at target, then stop.

    Each batch adds the rows whose key the table lacks, the first of each key, as a version of their own; of the stored rows only
    the keys are read, and nothing is rewritten. The stream's checkpoint is the ledger of files; as the merge is keyed, a batch
    that is replayed after a failure adds nothing twice.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def merge(batch: DataFrame, _: int) -> None:
        existing = read_deltas(spark, target)
        write_delta(new_rows(batch.limit(0) if existing is None else existing.select(*keys), batch, keys, order), target)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def track_orphans(spark: SparkSession, cases: str, schema, tracker: OrphanTracker, checkpoint: str, table_name: str = "training_cases", equations: DataFrame | None = None, retired: DataFrame | None = None) -> None:
    """Feed new files of cases to the tracker batch by batch; parents given are told with the first batch. The tracker keeps the number
    of the stream's last batch, so one that is replayed changes nothing."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(cases)
    parents = [keyed(equations, "ingested_at") if equations is not None else None, keyed(retired, "retired_at") if retired is not None else None]

    def advance(batch: DataFrame, number: int) -> None:
        tracker.advance(references(batch, table_name), *(parents if number == 0 else (None, None)), stream=f"{table_name} {checkpoint}", batch=number)

    stream.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
