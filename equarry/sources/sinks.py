"""Where results go: versioned tables, JSON arrays, reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_version(df: DataFrame, folder: str) -> str:
    """Write df as the next version below folder and then its commit record; the path that is read is never overwritten."""
    spark = df.sparkSession
    n = current_version(spark, folder) + 1
    df.write.mode("overwrite").parquet(f"{folder}/v{n}")
    spark.range(1).select(F.lit(n).alias("version")).write.mode("overwrite").parquet(f"{folder}/commits/{n}")
    return f"{folder}/v{n}"


def current_version(spark: SparkSession, folder: str) -> int:
    try:
        return spark.read.schema("version int").parquet(f"{folder}/commits/*").agg(F.max("version")).first()[0] or 0
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise


def read_version(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/v{current_version(spark, folder)}")


def write_delta(df: DataFrame, folder: str) -> None:
    """Add df as the next version of a table that grows: its rows are those of all versions (read_deltas)."""
    write_version(df, folder)


def read_deltas(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of all committed versions, None before the first."""
    n = current_version(spark, folder)
    return spark.read.parquet(*[f"{folder}/v{i}" for i in range(1, n + 1)]) if n else None


def append_if_any(existing: DataFrame, added: DataFrame, folder: str) -> bool:
    """A new version of existing and added, only if something was added."""
    if not added.limit(1).count():
        return False
    write_version(existing.unionByName(added, allowMissingColumns=True), folder)
    return True


def write_json_array(df: DataFrame, path: str, most: int = 1_000_000) -> None:
    """One indented JSON array in a local file, non-ASCII kept, for exchange with other tools. Rows are fetched part by part; more
    than most rows are refused, as such a table belongs in Parquet or JSON lines."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows; write Parquet instead")
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(df.toLocalIterator()):
            f.write(("," if i else "") + "\n  " + json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str, indent=2).replace("\n", "\n  "))
        f.write("\n]\n")


def derived_path(path: str, suffix: str = "_normalized") -> str:
    p = Path(path)
    return str(p.with_name(p.stem + suffix + p.suffix))


def markdown_table(df: DataFrame, by: str, most: int = 1000) -> str:
    """A small table, best first, as Markdown."""
    rows = df.orderBy(F.desc(by)).limit(most).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |\n" for r in rows)


def write_report(row: DataFrame, path: str) -> None:
    """A table of one row as one indented JSON object in a local file, nested values as they are."""
    found = row.limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"a report is one row, not {len(found)}")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(found[0].asDict(recursive=True), f, ensure_ascii=False, default=str, indent=2)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """A graph as the next version below folder: nodes(node, x, ...) and edges(src, dst); both count once the commit record is there."""
    spark = nodes.sparkSession
    n = current_version(spark, folder) + 1
    nodes.write.mode("overwrite").parquet(f"{folder}/v{n}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/v{n}/edges")
    spark.range(1).select(F.lit(n).alias("version")).write.mode("overwrite").parquet(f"{folder}/commits/{n}")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, edges) of the last version, None where none is stored."""
    if not (n := current_version(spark, folder)):
        return None
    return spark.read.parquet(f"{folder}/v{n}/nodes"), spark.read.parquet(f"{folder}/v{n}/edges")
