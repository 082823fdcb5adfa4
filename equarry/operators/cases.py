"""Training cases: symbols, variants, paraphrases, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equarry.functions.text import catalog_key, filled, filled_items, norm
from equarry.operators.skew import places

#: The texts put before a context.
TEMPLATES = (
    "This case describes the following physical model: ",
    "In this scenario, the underlying process can be summarized as: ",
    "From the perspective of process modeling, this case focuses on: ",
)
#: Seed of the hash that picks outputs.
SEED = "42"


def case_symbols(a: str = "input_variables", b: str = "output_variables") -> Column:
    """The distinct trimmed symbols of both lists, in order of appearance."""
    return F.array_distinct(F.concat(filled_items(a), filled_items(b)))


def symbol_sets(cases: DataFrame) -> DataFrame:
    """Union, intersection and difference of a case's inputs and outputs, sorted and joined."""
    i, o = filled_items("input_variables"), filled_items("output_variables")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), "|")
    return cases.select("row_id", joined(F.array_union(i, o)).alias("either"), joined(F.array_intersect(i, o)).alias("both"), joined(F.array_except(i, o)).alias("inputs_only"))


def modal_source(cases: DataFrame) -> DataFrame:
    """(row_id, source): the most frequent part before __ among a case's ids, the first seen of equals; unknown where no id has one."""
    each = cases.select("row_id", F.posexplode(filled_items("correct_model_ids")).alias("pos", "id")).where(F.col("id").contains("__"))
    by = each.groupBy("row_id", F.substring_index("id", "__", 1).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    best = by.groupBy("row_id").agg(F.min(F.struct(-F.col("n"), "first", "source")).getField("source").alias("source"))
    return cases.select("row_id").join(best, "row_id", "left").select("row_id", F.coalesce("source", F.lit("unknown")).alias("source"))


def signature(trimmed: bool) -> Column:
    """A case's context and lists as one value: trimmed and without empties, or as validation compares them."""
    if trimmed:
        lists = [F.array_sort(F.array_distinct(filled_items(c))) for c in ("input_variables", "output_variables", "correct_model_ids")]
    else:
        lists = [F.array_sort(F.transform(F.coalesce(c, F.array().cast("array<string>")), norm)) for c in ("input_variables", "output_variables")]
        lists.append(F.array_sort(F.transform(F.coalesce("correct_model_ids", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")))))
    return F.md5(F.to_json(F.struct(norm("context").alias("c"), *[x.alias(f"l{i}") for i, x in enumerate(lists)])))


def duplicate_groups(cases: DataFrame, trimmed: bool) -> DataFrame:
    """How many signatures two or more rows share, and how many rows these are."""
    by = cases.groupBy(signature(trimmed).alias("s")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return by.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def model_symbols(cores: DataFrame, equations: DataFrame) -> DataFrame:
    """(row_id, symbols): the sorted symbols of the equations a core case names; both sides of the id as stored."""
    ids = cores.select("row_id", F.explode(F.array_distinct("correct_model_ids")).alias("model_id"))
    symbols = equations.select(catalog_key("source_id", "eq_id").alias("model_id"), F.explode(F.map_keys("variables")).alias("symbol")).distinct()
    return ids.join(symbols, "model_id").groupBy("row_id").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))


def expanded(cores: DataFrame, equations: DataFrame, seed: str = SEED) -> DataFrame:
    """(row_id, variant, variant_type, context, input_variables, output_variables): up to nine variants of each core case: the original, three paraphrases, inputs and outputs exchanged where both exist, and
    four with outputs drawn from the symbols of its equations (else its own), the rest as inputs.

    Draws are by a hash of seed, case, variant and symbol, so they repeat.
    """
    own = F.array_sort(F.array_distinct(F.concat(F.coalesce("input_variables", F.array().cast("array<string>")), F.coalesce("output_variables", F.array().cast("array<string>")))))
    base = cores.select("row_id", "case_id", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("input_variables", F.array().cast("array<string>")).alias("i"), F.coalesce("output_variables", F.array().cast("array<string>")).alias("o"), F.filter(own, lambda x: x.isNotNull()).alias("own"))
    base = base.join(model_symbols(cores, equations), "row_id", "left").withColumn("pool", F.coalesce("symbols", "own"))
    texts = [F.col("context"), *[F.concat(F.lit(t), F.col("context")) for t in TEMPLATES]]

    def variant(number: str, kind: str, text: Column, i: Column, o: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(number).alias("variant"), F.lit(kind).alias("variant_type"), text.alias("context"), i.alias("input_variables"), o.alias("output_variables")))

    made = [variant("v1", "original", texts[0], F.col("i"), F.col("o"), F.lit(True))]
    made += [variant(f"p{k}", "context_paraphrased", texts[k], F.col("i"), F.col("o"), F.lit(True)) for k in (1, 2, 3)]
    made.append(variant("v2", "swap_io", texts[1], F.col("o"), F.col("i"), (F.size("i") > 0) & (F.size("o") > 0)))
    for v in (3, 4, 5, 6):
        draw = lambda x: F.md5(F.concat(F.lit(f"{seed}|"), F.col("row_id").cast("string"), F.lit(f"|{v}|"), x))  # noqa: B023, E731
        k = F.least(F.lit(1) + F.pmod(F.ascii(F.substring(draw(F.lit("")), 1, 1)), F.lit(2)), F.size("pool"))
        outs = F.slice(F.array_sort(F.transform("pool", lambda x: F.struct(draw(x).alias("h"), x.alias("s")))), 1, k)  # noqa: B023
        outs = F.array_sort(F.transform(outs, lambda x: x["s"]))
        made.append(variant(f"v{v}", "random_io_from_models", texts[min(v - 1, 3)], F.array_except("pool", outs), outs, F.size("pool") > 0))
    each = base.select("row_id", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x"))
    return each.select("row_id", "x.*")


def expand(cores: DataFrame, equations: DataFrame, seed: str = SEED) -> DataFrame:
    """expanded with the symbols of a list joined by |."""
    joined = lambda c: F.array_join(c, "|")
    return expanded(cores, equations, seed).select("row_id", "variant", "variant_type", "context", joined("input_variables").alias("inputs"), joined("output_variables").alias("outputs"))


def numbered(cores: DataFrame) -> DataFrame:
    """(row_id, number, base): core_001 and so on in the order of row_id, at least three digits."""
    placed = places(cores.select("row_id"), "row_id", "number").withColumn("number", F.col("number") + 1)
    return placed.select("row_id", "number", F.format_string("core_%03d", "number").alias("base"))


def expanded_cases(cores: DataFrame, equations: DataFrame, seed: str = SEED) -> DataFrame:
    """The variants as training cases ready to be loaded: case_id is the core's number and the variant's, original_core_id the
    core's own id as stored, correct_model_ids those of the core."""
    name = F.when(F.col("variant").startswith("p"), F.concat(F.lit("v1_para"), F.substring("variant", 2, 9))).otherwise(F.col("variant"))
    out = expanded(cores, equations, seed).join(numbered(cores), "row_id").join(cores.select("row_id", F.col("case_id").alias("original_core_id"), "correct_model_ids"), "row_id")
    return out.select(F.concat("base", F.lit("_"), name).alias("case_id"), "original_core_id", "variant_type", "context", "input_variables", "output_variables", F.coalesce("correct_model_ids", F.array().cast("array<string>")).alias("correct_model_ids"))


def paraphrase(cases: DataFrame) -> DataFrame:
    """New rows (row_id, k, case_id, context, and the lists) for the paraphrases of originals whose signature isn't there yet.

    Of new rows with equal signatures the first by (row_id, k) stays. A case_id that is taken gets the least free suffix _2,
    _3 and so on, in the same order. Running it again on the union adds nothing.
    """
    originals = cases.where((F.col("variant_type") == "original") & filled("case_id").isNotNull())
    each = originals.select("row_id", F.posexplode(F.array(*[F.concat(F.lit(t), norm("context")) for t in TEMPLATES])).alias("k", "context"), filled("case_id").alias("base"), "input_variables", "output_variables", "correct_model_ids")
    each = each.withColumn("k", F.col("k") + 1).withColumn("base", F.concat("base", F.lit("_para"), F.col("k").cast("string")))
    each = each.withColumn("s", signature(True)).withColumn("at", F.struct("row_id", "k"))
    first = each.groupBy("s").agg(F.min("at").alias("at"))
    fresh = first.join(cases.select(signature(True).alias("s")).distinct(), "s", "left_anti").select("at").join(each, "at")
    # numbers free for each base: of 1 .. new + taken, those not taken, the r-th for the r-th new row
    wanted = fresh.withColumn("r", F.row_number().over(Window.partitionBy("base").orderBy("at")))
    taken = cases.select(F.col("case_id").alias("t")).where("t is not null").distinct()
    split = taken.select("t", F.regexp_extract("t", r"^(.*)_(\d+)$", 1).alias("head"), F.regexp_extract("t", r"^(.*)_(\d+)$", 2).alias("tail"))
    used = taken.select(F.col("t").alias("base"), F.lit(1).alias("u")).unionByName(split.where("tail <> '' and length(tail) < 9 and not startswith(tail, '0') and tail <> '1'").select(F.col("head").alias("base"), F.col("tail").cast("int").alias("u")))
    used = used.join(wanted.select("base").distinct(), "base", "left_semi").groupBy("base").agg(F.collect_set("u").alias("used"))
    counted = wanted.groupBy("base").agg(F.max("r").cast("int").alias("m")).join(used, "base", "left")
    numbers = F.sequence(F.lit(1), F.col("m") + F.coalesce(F.size("used"), F.lit(0)))
    free = counted.select("base", F.posexplode(F.array_except(numbers, F.coalesce("used", F.array().cast("array<int>")))).alias("p", "u")).select("base", (F.col("p") + 1).alias("r"), "u")
    named = wanted.join(free, ["base", "r"]).withColumn("case_id", F.when(F.col("u") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("u").cast("string"))))
    return named.select("row_id", "k", "case_id", "context", "input_variables", "output_variables", "correct_model_ids")
