"""Records that differ only in layout: case, white space, punctuation, order of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equarry.operators.skew import salted_lookup
from equarry.session import materialize

TOKEN = r"\p{L}+|\p{Nd}+(?:[.,]\p{Nd}+)*"
NOT_SYMBOL = r"[^\p{L}\p{Nd}']+"
#: Sums of so many bits can't overflow for lists of under a hundred thousand elements.
MASK = (1 << 46) - 1


def context_form(c: str) -> Column:
    """The words and numbers of a text in order, in lower case; empty for null."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(TOKEN), F.lit(0)), " ")


def symbol_set(c: str) -> Column:
    """The distinct symbols of a list by their letters, digits and ', unordered; null is an empty list."""
    kept = F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.regexp_replace(x, NOT_SYMBOL, "")), lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(kept)


def _lane(fields: list[tuple[str, Column]], lists: list[tuple[str, Column]], salt: int) -> Column:
    """A sum of hashes of (field name, value), which no order of fields or elements changes."""
    total = F.lit(0).cast("long")
    for name, c in fields:
        total = total + F.xxhash64(F.lit(salt), F.lit(name), c).bitwiseAND(F.lit(MASK))
    for name, c in lists:
        hashed = F.transform(c, lambda x: F.xxhash64(F.lit(salt), F.lit(name), x).bitwiseAND(F.lit(MASK)))  # noqa: B023
        total = total + F.aggregate(hashed, F.lit(0).cast("long"), lambda a, x: a + x)
    return total


def _same_set(a: str, b: str) -> Column:
    return (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0)


def layout_copies(cases: DataFrame) -> DataFrame:
    """(row_id, first_row_id, n_copies) for each case that holds a word or number in its context.

    Each record's fields are normalised and every (field name, value) pair hashed in two lanes; the sums are the
    fingerprint. Fingerprints are grouped with partial sums, and every record of a group of two or more is compared,
    field by field and as sets, with the group's first record. Records that differ from it, which takes a collision of
    92 bits, are grouped once more by their whole normalised fields. Rows without a word or number are left out.
    """
    forms = cases.select("row_id", context_form("context").alias("c"), symbol_set("input_variables").alias("i"), symbol_set("output_variables").alias("o")).where("c <> ''")
    lanes = [_lane([("context", F.col("c"))], [("input", F.col("i")), ("output", F.col("o"))], salt).alias(f"f{salt}") for salt in (1, 2)]
    rows = materialize(forms.select("row_id", *lanes, "c", "i", "o"), "fingerprints")  # read twice below
    groups = materialize(rows.groupBy("f1", "f2").agg(F.min("row_id").alias("first_row_id"), F.count(F.lit(1)).alias("n")), "layouts")
    several = groups.where("n > 1")
    members = salted_lookup(rows, several, ["f1", "f2"], "n", "row_id", least=100_000)
    members = materialize(members, "members")
    firsts = members.where("row_id = first_row_id").select("f1", "f2", F.col("c").alias("c1"), F.col("i").alias("i1"), F.col("o").alias("o1")).join(several.select("f1", "f2", "n"), ["f1", "f2"])
    checked = salted_lookup(members, firsts, ["f1", "f2"], "n", "row_id", least=100_000).withColumn("same", (F.col("c") == F.col("c1")) & _same_set("i", "i1") & _same_set("o", "o1"))
    checked = materialize(checked.select("row_id", "f1", "f2", "first_row_id", "same"), "checked")
    alone = groups.where("n = 1").select(F.col("first_row_id").alias("row_id"), "first_row_id")
    good = checked.where("same").select("row_id", "first_row_id")
    out = alone.unionByName(good)
    odd = checked.where("not same").select("row_id")
    if odd.limit(1).count():
        whole = members.join(odd, "row_id", "left_semi").select("row_id", F.sha2(F.to_json(F.struct("c", F.array_sort("i").alias("i"), F.array_sort("o").alias("o"))), 256).alias("k"))
        firsts = whole.groupBy("k").agg(F.min("row_id").alias("first_row_id"), F.count(F.lit(1)).alias("n"))
        out = out.unionByName(salted_lookup(whole, firsts, ["k"], "n", "row_id").select("row_id", "first_row_id"))
    return out


def copy_counts(copies: DataFrame) -> DataFrame:
    """One row for each record: the row that stands for it and the number of rows that hold it."""
    return copies.groupBy("first_row_id").agg(F.count(F.lit(1)).alias("n_copies"), F.max("row_id").alias("last_row_id"))
