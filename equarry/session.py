"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine expects; a session made elsewhere may differ in all but the last two.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

#: Whether a query's shuffle files are removed when it ends, and not only when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "equarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; conf overrides them (dots written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


class NoSharedFolder(RuntimeError):
    """A cluster's session that names no folder all machines share."""


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or else the context's checkpoint folder.

    Only a session on one machine (local or local-cluster) may lack both and gets a temporary one; any other is refused, as
    executors would write to disks of their own and the driver would read rows that are missing.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        sc = spark.sparkContext
        set_by_context = sc._jsc.sc().getCheckpointDir()
        if set_by_context.isDefined():
            folder = set_by_context.get()
        elif sc.master.startswith("local"):
            folder = "file://" + tempfile.mkdtemp(prefix="equarry-")
            atexit.register(shutil.rmtree, folder.removeprefix("file://"), True)
        else:
            raise NoSharedFolder(f"set spark.checkpoint.dir to a folder that all machines of {sc.master} share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives the loss of executors.

    The table is compressed and columnar, so that later reads prune columns, and its size is known to the planner.
    It is removed when the driver's process ends; the shuffle files it was made of are removed at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/equarry-{name}-{uuid.uuid4().hex}"
    held = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, held)
    atexit.register(remove_path, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table of materialize() that nothing will read again."""
    if files := df.inputFiles():
        remove_path(df.sparkSession, files[0].rpartition("/")[0])


def remove_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; a folder set by the cluster is the cluster's to clean
        pass
