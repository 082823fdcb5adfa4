"""Counts and histograms of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equarry.functions.text import norm


def counts_of(df: DataFrame, column: str, blank: str | None = None) -> DataFrame:
    c = F.col(column) if blank is None else F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(blank))
    return df.groupBy(c.alias(column)).agg(F.count(F.lit(1)).alias("n"))


def variable_frequency(equations: DataFrame, n: int = 30) -> DataFrame:
    """The n most frequent symbols as stored; equally frequent ones as first seen."""
    each = equations.select("row_id", F.posexplode(F.map_keys("variables")).alias("pos", "symbol"))
    by = each.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_id", "pos")).alias("first"))
    return by.orderBy(F.desc("n"), "first").limit(n).select("symbol", "n")


def first_definitions(equations: DataFrame) -> DataFrame:
    """The first definition of each symbol that isn't null, trimmed; an empty one counts."""
    each = equations.select("row_id", F.posexplode("variables").alias("pos", "symbol", "definition")).where("definition is not null")
    return each.groupBy("symbol").agg(F.min(F.struct("row_id", "pos", norm("definition").alias("d"))).getField("d").alias("definition"))


def variable_stats(equations: DataFrame) -> DataFrame:
    """Least, most and mean number of symbols of a row with a map, and the number of different symbols."""
    sizes = equations.where("variables is not null").agg(F.min(F.size("variables")).alias("least"), F.max(F.size("variables")).alias("most"), F.round(F.avg(F.size("variables")), 6).alias("mean"))
    distinct = equations.select(F.explode(F.map_keys("variables")).alias("s")).agg(F.countDistinct("s").alias("n_symbols"))
    return sizes.crossJoin(distinct)  # one row each


def list_lengths(cases: DataFrame, columns: tuple[str, ...] = ("correct_model_ids", "input_variables", "output_variables")) -> DataFrame:
    """(field, length, n): how many rows have lists of each length; null lists have 0. One pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))), F.lit(0)).cast("string").alias("length")) for c in columns])).alias("p")
    return cases.select(pairs).groupBy("p.field", "p.length").agg(F.count(F.lit(1)).alias("n"))


def list_stats(cases: DataFrame) -> DataFrame:
    size = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>")))
    out = []
    for c, name in (("correct_model_ids", "models"), ("input_variables", "inputs"), ("output_variables", "outputs")):
        out += [F.min(size(c)).alias(f"least_{name}"), F.max(size(c)).alias(f"most_{name}"), F.round(F.avg(size(c)), 6).alias(f"mean_{name}")]
    return cases.agg(*out)


def cooccurrence(equations: DataFrame) -> DataFrame:
    """(a, b, weight), a before b: in how many rows both symbols occur. Pairs are made within a row's own symbols."""
    keys = F.array_sort(F.array_distinct(F.map_keys("variables")))
    a = equations.select(keys.alias("k")).select("k", F.posexplode("k").alias("i", "a"))
    pairs = a.select("a", F.explode(F.slice("k", F.col("i") + 2, F.size("k"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def cooccurrence_degree(pairs: DataFrame) -> DataFrame:
    """(symbol, degree): the pair occurrences a symbol takes part in."""
    return pairs.select(F.explode(F.array("a", "b")).alias("symbol"), "weight").groupBy("symbol").agg(F.sum("weight").alias("degree"))


def top_network(pairs: DataFrame, n: int = 60) -> DataFrame:
    """The pairs among the n symbols of highest degree; equal degrees by symbol. n bounds what is broadcast."""
    top = F.broadcast(cooccurrence_degree(pairs).orderBy(F.desc("degree"), "symbol").limit(n).select("symbol"))
    return pairs.join(top.withColumnRenamed("symbol", "a"), "a", "left_semi").join(top.withColumnRenamed("symbol", "b"), "b", "left_semi")

