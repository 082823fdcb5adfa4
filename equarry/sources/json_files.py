"""JSON corpora: a list of records, or an object that holds the list."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EQUATION = "source_id string, eq_id string, equation string, variables map<string,string>, context_text string, domain string"
CORE_CASE = "case_id string, context string, input_variables array<string>, output_variables array<string>, correct_model_ids array<string>"
TRAINING_CASE = CORE_CASE + ", original_core_id string, variant_type string"
HOLDERS = ("equations", "papers")


class WrongShape(ValueError):
    """A file that isn't a list of records, read strictly."""


def strip_fence(c: Column) -> Column:
    """Text without a Markdown code fence: the first line goes if it starts with ```, the last if it is ```."""
    t = F.trim(c)
    return F.when(F.startswith(t, F.lit("```")), F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n?```\s*$", ""))).otherwise(t)


def records(texts: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The records of whole JSON texts: a list, {"equations": [...]}, {"papers": [...]}, or one object that is a record itself.
    Code fences are taken off; text that isn't JSON gives no rows."""
    j = strip_fence(F.col(column))
    first = F.substring(j, 1, 1)
    body = F.when(first == "[", j)
    for h in HOLDERS:
        held = F.get_json_object(j, f"$.{h}")
        body = body.when(F.substring(held, 1, 1) == "[", held)
    body = body.when(first == "{", F.concat(F.lit("["), j, F.lit("]")))
    return texts.select(F.explode(F.from_json(body, f"array<struct<{_struct(schema)}>>")).alias("r")).where("r is not null").select("r.*")


def _struct(schema: str) -> str:
    out = ""
    for part in schema.split(", "):
        name, kind = part.split(" ", 1)
        out += ("," if out else "") + f"{name}:{kind}"
    return out


def read_json(spark: SparkSession, path: str, schema: str, strict: bool = False, missing_is_empty: bool = False, lists_only: bool = False) -> DataFrame:
    """Records of the JSON files at path. A missing path is an error unless missing_is_empty. strict wants a list of objects with
    values of the schema's types in each file. lists_only takes anything but a list as an empty one."""
    try:
        texts = spark.read.text(path, wholetext=True)
    except Exception as e:
        if missing_is_empty and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
    if strict:
        each = F.from_json("value", "array<string>")
        bad = texts.where(~F.startswith(F.trim("value"), F.lit("[")) | each.isNull() | F.exists(each, lambda x: x.isNull() | ~F.startswith(F.trim(x), F.lit("{"))))
        if bad.limit(1).count():
            raise WrongShape(f"{path} holds something else than a list of records")
        rows = texts.select(F.explode(each).alias("j")).select("j", F.from_json("j", schema, {"mode": "PERMISSIVE"}).alias("r"))
        if rows.where(F.exists(F.array(*_mismatches(schema)), lambda x: x)).limit(1).count():
            raise WrongShape(f"{path} holds a record with a field of another type")
        return rows.select("r.*")
    if lists_only:
        texts = texts.where(F.startswith(F.trim("value"), F.lit("[")))
    return records(texts, schema)


def _mismatches(schema: str) -> list[Column]:
    """For each field whether the JSON object j has a value that isn't null and isn't of the field's type."""
    out = []
    for part in schema.split(", "):
        name, kind = part.split(" ", 1)
        v = F.variant_get(F.try_parse_json("j"), f"$['{name}']", "variant")
        said = F.schema_of_variant(v)
        fits = F.startswith(said, F.lit("ARRAY")) if kind.startswith("array") else F.startswith(said, F.lit("OBJECT")) if kind.startswith("map") else said == "STRING" if kind == "string" else F.lit(True)
        out.append(F.coalesce(v.isNotNull() & ~F.is_variant_null(v) & ~fits, F.lit(False)))
    return out


def read_notation(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """The ordered replacements of a JSON file: under replacements_order, or the whole file, a list of [old, new]. A short list for
    the operators on notation; a missing file or key gives none, a pair that isn't two texts is an error."""
    try:
        value = spark.read.text(path, wholetext=True).first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    found = json.loads(value[0]) if value else []
    rules = found.get("replacements_order", []) if isinstance(found, dict) else found
    if not all(isinstance(r, list) and len(r) == 2 and all(isinstance(x, str) for x in r) for r in rules):
        raise WrongShape(f"{path} holds something else than pairs of texts")
    return [tuple(r) for r in rules]


def query_list(spark: SparkSession, queries: list[tuple[str, int]]) -> DataFrame:
    """(pos, query, most): searches written in the program, in their order."""
    return spark.createDataFrame([(i, q, n) for i, (q, n) in enumerate(queries)], "pos int, query string, most int")


def read_ledger(spark: SparkSession, path: str, seed: list[str] = ()) -> DataFrame:
    """file_name from a JSON list or {"processed": [...]}; a missing ledger starts with seed, which is stored there if there is any."""
    try:
        texts = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        names = spark.createDataFrame([(x,) for x in seed], "file_name string")
        if seed:
            write_ledger(names, path)
        return names
    body = F.when(F.startswith(F.trim("value"), F.lit("[")), F.col("value")).otherwise(F.get_json_object("value", "$.processed"))
    return texts.select(F.explode(F.from_json(body, "array<string>")).alias("file_name")).where("file_name is not null").distinct()


def write_ledger(files: DataFrame, path: str) -> None:
    """The distinct names, sorted, as one JSON list; a list of files, written by one task. Readers see the old list or the new one."""
    names = files.select("file_name").where("file_name is not null").distinct().agg(F.to_json(F.sort_array(F.collect_list("file_name"))).alias("value"))
    names.coalesce(1).write.mode("overwrite").text(path)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length and modification time of the files in a folder; contents aren't read unless asked for."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime", F.element_at(F.split("path", "/"), -1).alias("file_name"))
