"""A tie within one shard counts as in the unsharded search."""

from pyspark.sql import functions as F

import equarry.llm.entries as E


def test_tie_within_a_shard(spark, monkeypatch):
    shard = {0: [], 1: []}
    for i, k in spark.range(1, 30).select(F.col("id").cast("int"), F.pmod(F.xxhash64(F.col("id").cast("int")), F.lit(2))).collect():
        shard[k].append(i)
    a, b, c = shard[0][0], shard[0][1], shard[1][0]
    lists = {"domain": spark.createDataFrame([(a, "Condansing"), (b, "Condonsing"), (c, "Comdensong")], "id int, name string")}
    values = spark.createDataFrame([("domain", "condensing")], "field string, value string")
    one = E.nearest_entries(values, lists).first()
    monkeypatch.setattr(E, "FORMS", 8)
    cut = E.nearest_entries(values, lists).first()
    assert one["entry_id"] == cut["entry_id"] == 0 and one["cost"] == cut["cost"] == 1
