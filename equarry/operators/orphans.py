"""References to records that don't exist: keyed state of pending orphans, kept up batch by batch."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equarry.functions.text import filled_items, global_key
from equarry.operators.skew import salted_lookup
from equarry.session import materialize, remove_path, shared_folder

PARENTS = "ref_key string, arrived_at timestamp_ntz, retired_at timestamp_ntz"
REFS = "table_name string, row_id bigint, ref_key string, created_at timestamp_ntz, arrived_at timestamp_ntz, retired_at timestamp_ntz"


COMMIT = "version int, buckets int, parents map<string,int>, refs map<string,int>, batches map<string,bigint>"
#: Buckets of a new tracker's state; a large one is given more, as a small batch rewrites a bucket at least.
BUCKETS = 16


def references(df: DataFrame, table_name: str, ids: str = "correct_model_ids") -> DataFrame:
    """One row for each trimmed, non-blank id of a row; an id repeated in a row counts once. Null and empty lists give none."""
    each = F.explode(F.array_distinct(filled_items(ids)))
    return df.select(F.lit(table_name).alias("table_name"), "row_id", each.alias("ref_key"), F.col("created_at").cast("timestamp_ntz").alias("created_at"))


def keyed(df: DataFrame, at: str) -> DataFrame:
    """Key and time of each row that has a key; a row without a time says nothing about when."""
    return df.select(global_key("source_id", "eq_id").alias("ref_key"), F.col(at).cast("timestamp_ntz").alias("at")).where("ref_key is not null and at is not null")


def orphan_at_creation():
    """True where the parent is absent, not yet there or withdrawn at created_at. A reference without a time has no parent by then."""
    there = F.coalesce(F.col("arrived_at") <= F.col("created_at"), F.lit(False))
    gone = F.coalesce(F.col("retired_at") <= F.col("created_at"), F.lit(False))
    return ~there | gone


def reason():
    gone = F.coalesce(F.col("retired_at") <= F.col("created_at"), F.lit(False))
    return F.when(gone, "withdrawn").when(F.col("arrived_at") > F.col("created_at"), "not yet ingested").when(orphan_at_creation(), "absent")


class OrphanTracker:
    """State of all references against an index of parents, in buckets by key below a folder of the shared file system.

    Each batch may hold new references, parents that arrive and parents that are withdrawn, in any order and late. The
    parent index keeps for a key the earliest arrival and the earliest withdrawal. New references probe it; a key whose
    times change in a batch has its stored references probed again, so that an arrival resolves waiting orphans and a
    withdrawal reopens resolved ones; other stored references are carried over without a probe. A batch reads and writes only
    the buckets its keys fall into; a manifest names the version that holds each bucket. As times are those of the events,
    the state after any cutting of the same events into batches is the same. A version counts once its commit record is
    written; a batch that dies before leaves the version before it, whose files stay until the next but one. A hot key's
    references are probed in many tasks and its bucket is written by many.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = BUCKETS):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/orphans-{uuid.uuid4().hex}"
        if folder is None:
            atexit.register(remove_path, spark, self.folder)
        self.buckets, self.version, self.batches = buckets, 0, {}
        self.held: dict[str, dict[int, int]] = {"parents": {}, "refs": {}}
        self.outdated: dict[str, dict[int, int]] = {}
        self._load()

    def _load(self) -> None:
        """The last committed version: a row for each bucket of each table, and the last batch of each stream."""
        try:
            last = self.spark.read.schema(COMMIT).json(f"{self.folder}/commits/*").orderBy(F.desc("version")).first()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return
            raise
        if last:
            self.version, self.buckets = last["version"], last["buckets"]
            self.held = {t: {int(k): v for k, v in last[t].items()} for t in self.held}
            self.batches = dict(last["batches"])

    def _state(self, name: str, schema: str, some: set[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/v{v}/{name}/bucket={b}" for b, v in sorted(self.held[name].items()) if some is None or b in some]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def parents(self) -> DataFrame:
        return self._state("parents", PARENTS)

    def refs(self) -> DataFrame:
        """All references so far with the times of their parents."""
        return self._state("refs", REFS)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("ref_key"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _touched(self, df: DataFrame) -> set[int]:
        return {r[0] for r in df.select(self._bucket()).distinct().collect()}

    def _write(self, df: DataFrame, name: str, held: dict[str, dict[int, int]]) -> None:
        """Rewrite the buckets of df; rows are spread over tasks by bucket, large buckets over several."""
        target = f"{self.folder}/v{self.version + 1}/{name}"
        df.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(target)
        try:
            written = self.spark.read.parquet(target)
        except Exception as e:
            if "UNABLE_TO_INFER_SCHEMA" in str(e):  # no rows
                return
            raise
        held[name] |= {b: self.version + 1 for b in {int(f.rpartition("bucket=")[2].split("/")[0]) for f in written.inputFiles()}}

    def advance(self, new: DataFrame | None = None, arrivals: DataFrame | None = None, deletions: DataFrame | None = None, stream: str = "", batch: int | None = None) -> None:
        """Take in a batch: new as of references(), arrivals and deletions as of keyed(). A numbered batch of a stream that is committed
        already changes nothing."""
        if batch is not None and batch <= self.batches.get(stream, -1):
            return
        before = self.held
        try:
            self._advance(new, arrivals, deletions, stream, batch)
        except BaseException:
            self.held = before
            raise

    def _advance(self, new: DataFrame | None, arrivals: DataFrame | None, deletions: DataFrame | None, stream: str, batch: int | None) -> None:
        before, held = self.held, {t: dict(b) for t, b in self.held.items()}
        never = F.lit(None).cast("timestamp_ntz")
        events = [x.select("ref_key", F.col("at").alias("arrived_at") if k else never.alias("arrived_at"), never.alias("retired_at") if k else F.col("at").alias("retired_at")) for k, x in ((1, arrivals), (0, deletions)) if x is not None]
        changed, touched = self.spark.createDataFrame([], "ref_key string"), set()
        if events:
            told = events[0] if len(events) == 1 else events[0].unionByName(events[1])
            told = materialize(told.groupBy("ref_key").agg(F.min("arrived_at").alias("arrived_at"), F.min("retired_at").alias("retired_at")), "told")
            touched = self._touched(told) if self.version else set()
            old = self._state("parents", PARENTS, touched)
            index = old.unionByName(told).groupBy("ref_key").agg(F.min("arrived_at").alias("arrived_at"), F.min("retired_at").alias("retired_at")) if self.version else told
            self._write(index, "parents", held)
            if self.version:
                same = F.col("n.arrived_at").eqNullSafe(F.col("o.arrived_at")) & F.col("n.retired_at").eqNullSafe(F.col("o.retired_at"))
                now = told.alias("t").join(old.alias("o"), "ref_key", "left").select("ref_key", F.least("t.arrived_at", "o.arrived_at").alias("arrived_at"), F.least("t.retired_at", "o.retired_at").alias("retired_at"))
                changed = materialize(now.alias("n").join(old.alias("o"), "ref_key", "left").where(~same | F.col("o.ref_key").isNull()).select("ref_key"), "changed")
        self.held = held  # what follows probes the new index
        probing, kept = new, None
        if self.version:
            if new is not None:
                new = probing = materialize(new, "newrefs")
            some = self._touched(changed) | (self._touched(new) if new is not None else set())
            refs = self._state("refs", REFS, some)
            counted = refs.groupBy("ref_key").agg(F.count(F.lit(1)).alias("n")).join(changed, "ref_key").withColumn("again", F.lit(True))
            marked = materialize(salted_lookup(refs, materialize(counted, "counted"), ["ref_key"], "n", "row_id", "left"), "marked")
            kept = marked.where("again is null").drop("again")
            again = marked.where("again").drop("again", "arrived_at", "retired_at")
            probing = again if new is None else again.unionByName(new)
            index = self._state("parents", PARENTS, some)
        else:
            index = self.parents()
        if probing is not None:
            counts = probing.groupBy("ref_key").agg(F.count(F.lit(1)).alias("n"))
            told_times = materialize(counts.join(index, "ref_key", "left"), "parents")  # read twice below
            out = salted_lookup(probing, told_times, ["ref_key"], "n", "row_id")
            out = out if kept is None else out.unionByName(kept)
            self._write(out.select("table_name", "row_id", "ref_key", "created_at", "arrived_at", "retired_at"), "refs", held)
        batches = self.batches | ({stream: batch} if batch is not None else {})
        commit = self.spark.createDataFrame([(self.version + 1, self.buckets, {str(k): v for k, v in held["parents"].items()}, {str(k): v for k, v in held["refs"].items()}, batches)], COMMIT)
        commit.coalesce(1).write.mode("overwrite").json(f"{self.folder}/commits/{self.version + 1}")
        self.version, self.batches = self.version + 1, batches
        for name, was in self.outdated.items() if self.version > 1 else ():
            for b, v in was.items():
                remove_path(self.spark, f"{self.folder}/v{v}/{name}/bucket={b}")
        self.outdated = {t: {b: v for b, v in before[t].items() if held[t].get(b) != v} for t in held}


def orphan_counts(refs: DataFrame) -> DataFrame:
    """References and those without a parent at creation, by reason, per table and month of created_at; no time gives the month null."""
    kind = refs.withColumn("reason", reason())
    month = F.date_format("created_at", "yyyy-MM").alias("month")
    count = lambda x: F.count_if(F.coalesce(F.col("reason") == x, F.lit(False)))
    return kind.groupBy("table_name", month).agg(
        F.count(F.lit(1)).alias("n_refs"), F.count("reason").alias("n_orphans"),
        count("absent").alias("n_absent"), count("not yet ingested").alias("n_not_yet"), count("withdrawn").alias("n_withdrawn"),
    )


def open_orphans(refs: DataFrame) -> DataFrame:
    """Per table and month: orphans opened, resolved by a parent's arrival, reopened by a withdrawal, and open at the month's end."""
    c, a, r = F.col("created_at"), F.col("arrived_at"), F.col("retired_at")
    opened = orphan_at_creation()
    before = lambda x, y: F.coalesce(x <= y, F.lit(False))
    resolved = (a > c) & ~before(r, a)
    reopened = (r > c) & before(a, r) & (r > a)
    moves = refs.where(c.isNotNull()).select("table_name", F.explode(F.array(
        F.struct(F.when(opened, c).alias("at"), F.lit(1).alias("o"), F.lit(0).alias("s"), F.lit(0).alias("w")),
        F.struct(F.when(resolved, a).alias("at"), F.lit(0).alias("o"), F.lit(1).alias("s"), F.lit(0).alias("w")),
        F.struct(F.when(reopened, r).alias("at"), F.lit(0).alias("o"), F.lit(0).alias("s"), F.lit(1).alias("w")),
    )).alias("m")).where("m.at is not null")
    by = moves.groupBy("table_name", F.date_format("m.at", "yyyy-MM").alias("month")).agg(F.sum("m.o").alias("opened"), F.sum("m.s").alias("resolved"), F.sum("m.w").alias("reopened"))
    from pyspark.sql import Window

    so_far = Window.partitionBy("table_name").orderBy("month")
    return by.withColumn("open_at_end", F.sum(F.col("opened") - F.col("resolved") + F.col("reopened")).over(so_far))
