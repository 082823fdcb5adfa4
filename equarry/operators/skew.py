"""Joins, ranks and running totals that don't gather a hot key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: At most so many keys can be hot; that bounds what salted_lookup broadcasts.
MOST_HOT = 2000


def salted_lookup(facts: DataFrame, dim: DataFrame, keys: list[str], n: str, spread: str, how: str = "inner", least: int = 200_000) -> DataFrame:
    """facts joined with dim on keys; dim has one row for a key and, in column n, the number of its rows in facts.

    A key with more than least rows is hot, at most the MOST_HOT most frequent ones; any other has fewer than a MOST_HOT-th of
    all rows. So the list of hot keys is broadcast whatever the size of the data; facts' rows of a hot key are dealt over
    slices by a hash of the column spread, so that a repeated task deals them alike, and dim's row of it is repeated for
    each slice. Other keys are joined as they are. n isn't in the result. A null key matches nothing.
    """
    spark = facts.sparkSession
    hot = dim.where(F.col(n) > least).orderBy(F.desc(n)).limit(MOST_HOT).select(*keys, F.col(n).cast("long").alias("__slices"))
    rows = hot.collect()
    if not rows:
        return facts.join(dim.drop(n), keys, how)
    size = max(least, rows[-1]["__slices"]) if len(rows) == MOST_HOT else least
    hot = F.broadcast(spark.createDataFrame(rows, hot.schema).withColumn("__slices", F.ceil(F.col("__slices") / size).cast("int")))
    slice_of = F.when(F.col("__slices").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("__slices")).cast("int"))
    left = facts.join(hot, keys, "left").withColumn("__slice", slice_of).drop("__slices")
    right = dim.join(hot, keys, "left").withColumn("__slice", F.explode(F.sequence(F.lit(0), F.coalesce("__slices", F.lit(1)) - 1))).drop("__slices", n)
    return left.join(right, [*keys, "__slice"], how).drop("__slice")


def slices_for(rows: int, per_slice: int = 100_000, least: int = 16) -> int:
    return max(least, -(-rows // per_slice))


def dense_rank_within(df: DataFrame, key: list[str], order: list[Column], slice_by: Column, slices: int, name: str = "rank") -> DataFrame:
    """Numbers the rows of each key from 0 without gaps, a hot key's rows in many tasks.

    Rows are dealt over slices by slice_by (a hash), numbered within (key, slice), and moved by the rows of the key's
    earlier slices; only the counts of (key, slice), at most keys times slices, pass through a window over the key.
    """
    df = df.withColumn("__slice", F.pmod(slice_by, F.lit(slices)).cast("int"))
    counts = df.groupBy(*key, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*key, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*key, "__slice").orderBy(*order)
    ranked = df.withColumn("__rank", F.row_number().over(inside) - 1)
    return ranked.join(starts, [*key, "__slice"]).withColumn(name, (F.col("__start") + F.col("__rank")).cast("long")).drop("__slice", "__start", "__rank")


def running_total(df: DataFrame, key: list[str], weight: str, order_hash: str, tie: str, slices: int, name: str = "before") -> DataFrame:
    """Adds the sum of weight over the rows of the same key that precede a row by (order_hash, tie), a BIGINT hash and a unique column.

    The hash's range is cut into slices, a power of two; a row's total is the sum of the earlier slices plus that of its own slice's
    earlier rows, so no task holds all rows of a key.
    """
    bits = max(1, (slices - 1).bit_length())
    df = df.withColumn("__slice", F.shiftright(order_hash, 64 - bits))
    sums = df.groupBy(*key, "__slice").agg(F.sum(weight).alias("__sum"))
    earlier = Window.partitionBy(*key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*key, "__slice", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*key, "__slice").orderBy(order_hash, tie).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("__own", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return out.join(starts, [*key, "__slice"]).withColumn(name, (F.col("__start") + F.col("__own")).cast("long")).drop("__slice", "__start", "__own")


def salted_pairs(members: DataFrame, key: str, row_id: str, n: str, carry: list[str], least: int = 2_000) -> DataFrame:
    """All pairs of different rows with the same key, the smaller row_id first, as row_id_a, row_id_b and carry's columns with _a and _b.

    n is the number of rows with the key. The left rows of a large group are dealt over slices and the right rows repeated
    for each, so that a task makes at most some millions of pairs. For groups whose pairs are themselves the result.
    """
    slices = F.ceil(F.col(n) / least).cast("int")
    left = members.select(key, F.pmod(F.xxhash64(row_id), slices).cast("int").alias("__slice"), F.col(row_id).alias(f"{row_id}_a"), *[F.col(c).alias(f"{c}_a") for c in carry])
    right = members.select(key, F.explode(F.sequence(F.lit(0), slices - 1)).alias("__slice"), F.col(row_id).alias(f"{row_id}_b"), *[F.col(c).alias(f"{c}_b") for c in carry])
    return left.join(right, [key, "__slice"]).where(F.col(f"{row_id}_a") < F.col(f"{row_id}_b")).drop(key, "__slice")


def places(df: DataFrame, by: str, name: str = "at") -> DataFrame:
    """Adds each row's place from 0 in the order of by, a BIGINT without repeats: the range of by is cut into slices, each numbered by
    itself and moved by the rows of the slices before it, so no task sorts all rows."""
    low, high, n = df.agg(F.min(by), F.max(by), F.count(F.lit(1))).first()
    if not n:
        return df.withColumn(name, F.lit(0).cast("long"))
    slices = slices_for(n)
    df = df.withColumn("__slice", F.floor((F.col(by) - low) / ((high - low + 1) / slices)).cast("int"))
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n")).select("__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy("__slice").orderBy(by)) - 1)
    return ranked.join(starts, "__slice").withColumn(name, (F.col("__start") + F.col("__rank")).cast("long")).drop("__slice", "__start", "__rank")
