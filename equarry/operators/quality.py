"""Checks of cases against equations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equarry.functions.text import filled_items, norm
from equarry.operators.corpus import keyed_equations

#: The fields a case must have.
FIELDS = ("case_id", "original_core_id", "variant_type", "context", "input_variables", "output_variables", "correct_model_ids")


def _references(cases: DataFrame) -> DataFrame:
    return cases.select("row_id", F.explode(filled_items("correct_model_ids")).alias("key"))


def missing_references(cases: DataFrame, equations: DataFrame) -> DataFrame:
    """(row_id, key): ids, repeated ones each time, that no equation has."""
    return _references(cases).join(keyed_equations(equations).select("key").distinct(), "key", "left_anti").select("row_id", "key")


def missing_totals(cases: DataFrame, equations: DataFrame) -> DataFrame:
    return missing_references(cases, equations).agg(F.count(F.lit(1)).alias("n_missing"), F.countDistinct("row_id").alias("n_cases"))


def inconsistent_symbols(cases: DataFrame, equations: DataFrame, with_place: bool = False) -> DataFrame:
    """(row_id, symbol), and with_place at, the symbol's place: input or output symbols, repeated ones each time, that none of the case's equations has; all of them
    where no equation is found. Of equations with the same key the last one counts."""
    last = keyed_equations(equations).groupBy("key").agg(F.max_by("variables", "row_id").alias("variables"))
    symbols = last.select("key", F.explode(F.array_distinct(F.transform(F.map_keys("variables"), norm))).alias("symbol"))
    known = _references(cases).distinct().join(symbols, "key").select("row_id", "symbol").distinct()
    used = cases.select("row_id", F.posexplode(F.concat(filled_items("input_variables"), filled_items("output_variables"))).alias("at", "symbol"))
    out = used.join(known, ["row_id", "symbol"], "left_anti")
    return out if with_place else out.drop("at")


def inconsistent_cases(cases: DataFrame, equations: DataFrame) -> DataFrame:
    """(row_id, n_bad, examples): the count and the first ten different symbols in sorted order."""
    by = inconsistent_symbols(cases, equations).groupBy("row_id").agg(F.count(F.lit(1)).alias("n_bad"), F.array_sort(F.collect_set("symbol")).alias("s"))
    return by.select("row_id", "n_bad", F.array_join(F.slice("s", 1, 10), "|").alias("examples"))


def absent_fields(raw: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, n): in how many JSON objects of raw(json) a key is absent; a key with the value null is there."""
    keys = F.json_object_keys("json")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (~F.coalesce(F.array_contains(keys, f), F.lit(False))).cast("int").alias("a")) for f in fields])).alias("x")
    return raw.select(each).groupBy("x.field").agg(F.sum("x.a").cast("bigint").alias("n"))
