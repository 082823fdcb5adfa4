"""Splits in which related records stay together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equarry.functions.text import filled, filled_items
from equarry.llm.components import components
from equarry.operators.skew import running_total, salted_lookup, slices_for
from equarry.session import materialize

SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def case_units(cases: DataFrame) -> DataFrame:
    """cases with unit: the trimmed original_core_id, or where that is blank the row alone."""
    core = filled("original_core_id")
    return cases.withColumn("unit", F.coalesce(F.concat(F.lit("core:"), core), F.concat(F.lit("row:"), F.col("row_id").cast("string"))))


def unit_files(cases: DataFrame, equations: DataFrame) -> DataFrame:
    """Distinct (unit, file): the files that the cases of a unit name.

    Files are the trimmed, non-blank source_ids of equations; an id names the part before its first __ if that is one.
    """
    named = case_units(cases).select("unit", F.explode(F.array_distinct(F.transform(F.filter(filled_items("correct_model_ids"), lambda x: x.contains("__")), lambda x: F.substring_index(x, "__", 1)))).alias("file")).distinct()
    named = materialize(named, "named")
    files = equations.select(filled("source_id").alias("file")).where("file is not null").distinct()
    known = named.groupBy("file").agg(F.count(F.lit(1)).alias("n")).join(files, "file")
    return salted_lookup(named, known, ["file"], "n", "unit").select("unit", "file")


def file_groups(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (unit, file): (file, component) of the files tied to another, and (unit, file) with one file for each unit.

    A unit's files are tied to its least file alone, which gives as many edges as there are pairs instead of all pairs.
    """
    pairs = materialize(pairs, "pairs")
    centres = materialize(pairs.groupBy("unit").agg(F.min("file").alias("centre"), F.count(F.lit(1)).alias("n")), "centres")
    edges = salted_lookup(pairs, centres.where("n > 1"), ["unit"], "n", "file").where("file <> centre").select(F.col("centre").alias("src"), F.col("file").alias("dst"))
    return materialize(components(edges.distinct()), "components"), centres


def tied_files(cases: DataFrame, equations: DataFrame) -> DataFrame:
    """(group_key, source_id): each file that must stay with a smaller one, with the smallest file of its group."""
    grouped, _ = file_groups(unit_files(cases, equations))
    return grouped.where("node <> component").select(F.col("component").alias("group_key"), F.col("node").alias("source_id"))


def assign_splits(cases: DataFrame, equations: DataFrame, shares=SHARES) -> DataFrame:
    """(row_id, split, component) for each case; no file and no core case is in two splits.

    A component holds the cases of all units whose files are tied; a unit that names no file is a component of its own.
    Components larger than the smallest share, of which there are only a few, come first and so fall into the first
    split; the others follow in the order of a hash. The middle of a component in the running count of cases decides
    its split, so each share is met but for the size of one component, and the split of a component doesn't change when
    records are stored again. One component may hold most cases; then the shares can't be met, see split_shares.
    """
    grouped, centres = file_groups(unit_files(cases, equations))
    per_centre = centres.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).join(grouped.withColumnRenamed("node", "centre"), "centre", "left")
    of_unit = salted_lookup(centres.select("unit", "centre"), per_centre, ["centre"], "n", "unit").select("unit", F.concat(F.lit("file:"), F.coalesce("component", "centre")).alias("component"))
    per_unit = case_units(cases).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    units = materialize(per_unit.join(of_unit, "unit", "left").withColumn("component", F.coalesce("component", "unit")), "units")
    sizes = materialize(units.groupBy("component").agg(F.sum("n").alias("cases"), F.count(F.lit(1)).alias("units")).withColumn("h", F.xxhash64("component")), "sizes")
    total, parts = sizes.agg(F.coalesce(F.sum("cases"), F.lit(0)), F.count(F.lit(1))).first()
    large = F.col("cases") > total * min(s for _, s in shares)
    placed = running_total(sizes.withColumn("late", F.when(large, 0).otherwise(1)), ["late"], "cases", "h", "component", slices_for(parts))
    first = sizes.where(large).agg(F.coalesce(F.sum("cases"), F.lit(0))).first()[0]
    middle = (F.col("before") + F.col("late") * F.lit(first) + F.col("cases") / 2) / F.lit(max(total, 1))
    split = F.lit(shares[-1][0])
    for name, share in reversed(shares[:-1]):
        split = F.when(middle < sum(s for _, s in shares[: [n for n, _ in shares].index(name) + 1]), F.lit(name)).otherwise(split)
    by_component = placed.select("component", split.alias("split"), "units")
    by_unit = materialize(salted_lookup(units, by_component, ["component"], "units", "unit").select("unit", "component", "split", "n"), "unitsplits")
    return salted_lookup(case_units(cases).select("row_id", "unit"), by_unit, ["unit"], "n", "row_id").select("row_id", "split", "component")


def split_shares(assigned: DataFrame) -> DataFrame:
    """Cases and components of each split, and its share of the cases."""
    from pyspark.sql import Window

    by = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("n_cases"), F.countDistinct("component").alias("n_components"))
    return by.withColumn("share", F.round(F.col("n_cases") / F.sum("n_cases").over(Window.partitionBy()), 6))
