"""The p queries: callables of (spark, folder)."""

from __future__ import annotations

from pyspark.sql import functions as F

from equarry.llm import entries, layouts, lookalike, mixing, neardup, packing, splits
from equarry.session import materialize
from equarry.sources.tables import table


def p1_found(spark, folder):
    return splits.tied_files(table(spark, folder, "training_cases"), table(spark, folder, "equations"))


def p1_splits(spark, folder):
    return splits.assign_splits(table(spark, folder, "training_cases"), table(spark, folder, "equations")).select("row_id", "split")


def p1_shares(spark, folder):
    return splits.split_shares(splits.assign_splits(table(spark, folder, "training_cases"), table(spark, folder, "equations")))


def p5_found(spark, folder):
    copies = layouts.layout_copies(table(spark, folder, "training_cases"))
    return copies.where("row_id <> first_row_id").select("first_row_id", "row_id")


def p5_records(spark, folder):
    return layouts.copy_counts(layouts.layout_copies(table(spark, folder, "training_cases")))


def p2_found(spark, folder):
    return neardup.near_duplicate_rows(table(spark, folder, "equations"))


def p2_groups(spark, folder):
    return neardup.near_duplicate_groups(table(spark, folder, "equations"))


def p8_found(spark, folder):
    return lookalike.same_looking(table(spark, folder, "documents"))


def p8_texts(spark, folder):
    documents = table(spark, folder, "documents")
    return lookalike.text_forms(documents).select("doc_id", "form", (F.md5("form") != F.col("stored")).alias("changed"))


def _mapped(spark, folder):
    return entries.mapped_values(*(table(spark, folder, t) for t in ("equations", "domain_list", "quantity_list")))


def p4_found(spark, folder):
    return _mapped(spark, folder).select("row_id", "field", "symbol", "entry_id")


def p4_unmatched(spark, folder):
    """Each value that stands for no entry, with the number of its rows."""
    return _mapped(spark, folder).where("entry_id = 0").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def p6_containers(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"))


def p6_fill(spark, folder):
    return packing.fill_report(packing.pack_documents(table(spark, folder, "documents")))


def p7_selection(spark, folder):
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_shares(spark, folder):
    targets = table(spark, folder, "mix_targets")
    return mixing.mix_report(mixing.mix(table(spark, folder, "documents"), targets), targets)


def p1_kept_together(spark, folder):
    """Cases, and how many files and core cases lie in two splits."""
    cases, equations = table(spark, folder, "training_cases"), table(spark, folder, "equations")
    split = splits.assign_splits(cases, equations).select("row_id", "split")
    split = materialize(splits.case_units(cases).select("row_id", "unit").join(split, "row_id"), "splitunits")
    units = split.select("unit", "split").distinct()
    torn = lambda df, key, name: df.select(key, "split").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).alias(name))
    files = splits.unit_files(cases, equations).join(units, "unit")
    return split.agg(F.count(F.lit(1)).alias("n_cases")).crossJoin(torn(units, "unit", "torn_cores")).crossJoin(torn(files, "file", "torn_files"))  # one row each


def p6_all_placed(spark, folder):
    """Documents with text, how many are in containers, containers over the capacity, and parts of texts that would fit whole."""
    documents = table(spark, folder, "documents")
    packed = materialize(packing.pack_documents(documents), "packed")
    over = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("k")).agg(F.count_if(F.col("k") > packing.CAPACITY).alias("n_over"))
    parts = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("k"))
    placed = parts.agg(F.count(F.lit(1)).alias("n_placed"), F.count_if((F.col("parts") > 1) & (F.col("k") <= packing.CAPACITY)).alias("n_torn"))
    return documents.where("text <> ''").agg(F.count(F.lit(1)).alias("n_texts")).crossJoin(placed).crossJoin(over)  # one row each


def p7_within_caps(spark, folder):
    """Collections that are listed and have texts, how many got some, and texts taken more often than their collection allows."""
    documents, targets = table(spark, folder, "documents"), table(spark, folder, "mix_targets")
    picked = materialize(mixing.mix(documents, targets), "picked")
    most = picked.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("k")).join(targets.select("source", "max_repeats"), "source", "left")
    over = most.agg(F.count_if(F.coalesce(F.col("k") > F.col("max_repeats"), F.lit(True))).alias("n_over"))
    return picked.agg(F.countDistinct("source").alias("n_served")).crossJoin(over)  # one row each


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_splits, p1_shares, p2_found, p2_groups, p4_found, p4_unmatched, p5_found, p5_records, p6_containers, p6_fill, p7_selection, p7_shares, p8_found, p8_texts, p1_kept_together, p6_all_placed, p7_within_caps)
}
