import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from equarry.operators import cases as C
from equarry.operators import encoding, reports, retrieval
from equarry.sources import connectors, json_files, sinks

EQ = "row_id bigint, source_id string, eq_id string, equation string, variables map<string,string>, context_text string, domain string"
CASE = "row_id bigint, case_id string, original_core_id string, variant_type string, context string, input_variables array<string>, output_variables array<string>, correct_model_ids array<string>"


def tables(spark):
    eqs = [(0, "s", "1", "", {"t": "Time", "V": "v" * 70}, "", "d"), (1, "s", "2", "", {"t": "", "z": None}, "", None), (2, "s", "3", "", None, "", "d")]
    cases = [(0, "a", "o", "original", "c", ["t", "q"], ["q", "w"], ["s__1", None]), (1, "b", "o", None, " ", None, None, None), (2, "a2", "o ", "original", "c ", ["q", "t"], ["w", "q"], ["s__1", ""])]
    return spark.createDataFrame(eqs, EQ), spark.createDataFrame(cases, CASE)


def test_text_report(spark):
    eqs, cases = tables(spark)
    text = reports.text_report(reports.report_lines(eqs, cases))
    assert "Total number of equations (nodes):  3" in text and "Variables per equation:  min = 0, max = 2, mean = 1.33" in text
    assert "V" + " " * 24 + "      1  |  " + "v" * 60 + "...\n" in text and "(no definition)" in text
    assert "Node degree:  min = 1, max = 1, mean = 1.00" in text and "   Correct model equations per case:  min = 0, max = 2, mean = 1.33" in text
    empty = reports.text_report(reports.report_lines(eqs.limit(0), cases.limit(0)))
    assert "Total number of training cases:  0" in empty and "mean = 0.00" in empty


def test_health_report(spark, tmp_path):
    eqs, cases = tables(spark)
    raw = spark.createDataFrame([(json.dumps({k: None for k in ("case_id", "context")}),)], "json string")
    sinks.write_report(reports.health_report(cases, eqs, raw), str(tmp_path / "r.json"))
    got = json.loads((tmp_path / "r.json").read_text())
    assert (got["n_equations"], got["n_cases"], got["io_not_in_any_correct_model_vars_cases"], got["io_not_in_any_correct_model_vars_total_vars"]) == (3, 3, 2, 6)
    assert got["duplicate_signature_groups"] == 1 and got["duplicate_signature_cases"] == 2 and got["variant_type_counts"] == {"original": 2, "unknown": 1}
    assert got["n_correct_models_hist"] == {"0": 1, "2": 2} and set(got["cases_missing_fields"]) == {"original_core_id", "variant_type", "input_variables", "output_variables", "correct_model_ids"}
    assert [e["missing_vars"] for e in got["io_not_in_any_correct_model_vars_examples"]] == [["q", "q", "w"], ["q", "w", "q"]]
    with pytest.raises(ValueError):
        sinks.write_report(cases, str(tmp_path / "x.json"))


def test_expanded_cases_load(spark):
    core = spark.createDataFrame([(5, "own id", "c", ["t"], ["V"], ["s__1"]), (9, None, None, None, None, None)], "row_id bigint, case_id string, context string, input_variables array<string>, output_variables array<string>, correct_model_ids array<string>")
    rows = C.expanded_cases(core, tables(spark)[0]).collect()
    by = {r["case_id"]: r for r in rows}
    assert len(by) == len(rows) == 13 and {"core_001_v1", "core_001_v1_para3", "core_001_v2", "core_001_v6", "core_002_v1"} <= set(by)
    assert by["core_001_v2"]["input_variables"] == ["V"] and by["core_001_v2"]["original_core_id"] == "own id" and by["core_002_v1"]["correct_model_ids"] == []


def test_small_operators(spark):
    eqs, cases = tables(spark)
    assert reports.with_text(cases).count() == 2 and reports.first_cases(cases, 2).count() == 2 and reports.first_cases(cases).count() == 3
    maps = spark.sql("select map('a','1','b','2') x, map('b','3','c','4') y union all select null, map('k','v') union all select map('k','v'), null")
    assert [r[0] for r in maps.select(reports.merged_params("x", "y")).collect()] == [{"a": "1", "b": "3", "c": "4"}, {"k": "v"}, {"k": "v"}]
    assert spark.range(1).select(reports.shortened(F.lit("abcdef"), 3, "…"), reports.shortened(F.lit("abc"), 3)).first()[:] == ("abc…", "abc")
    assert {r[1] for r in retrieval.source_split(spark.createDataFrame([(i, f"s{i}", "1", "", {}, "", "") for i in range(10)], EQ), validation=0).collect()} == {"test", "train"}


def test_encoder(spark):
    texts = spark.createDataFrame([(1, "pump head", "q"), (2, "Head PUMP", "q"), (3, None, "q"), (4, "valve", "q")], "node bigint, text string, x string")
    x = {r["node"]: np.array(r["x"]) for r in encoding.encode(texts).collect()}
    assert np.allclose(x[1], x[2]) and not x[3].any() and abs(np.linalg.norm(x[4]) - 1) < 1e-5 and len(x[1]) == encoding.DIMS
    own = encoding.encode(texts, lambda: lambda batch: np.array([[len(t), len(batch)] for t in batch]), batch=3)
    assert all(r["x"][0] == len({1: "pump head", 2: "Head PUMP", 3: "", 4: "valve"}[r["node"]]) for r in own.collect())
    assert encoding.encode(texts.limit(0)).collect() == []


def test_graph_is_stored_and_read(spark, tmp_path):
    assert sinks.read_graph(spark, str(tmp_path / "g")) is None
    nodes, edges = spark.createDataFrame([(1, [0.5])], "node bigint, x array<double>"), spark.createDataFrame([(1, 1)], "src bigint, dst bigint")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    sinks.write_graph(nodes, edges.limit(0), str(tmp_path / "g"))
    got = sinks.read_graph(spark, str(tmp_path / "g"))
    assert got[0].collect() == nodes.collect() and got[1].count() == 0


def test_notation_ledger_and_queries(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"replacements_order": [["b", "c"], ["a", "b"]]}))
    assert json_files.read_notation(spark, str(tmp_path / "n.json")) == [("b", "c"), ("a", "b")] and json_files.read_notation(spark, str(tmp_path / "none.json")) == []
    (tmp_path / "bad.json").write_text("[[1, 2]]")
    with pytest.raises(json_files.WrongShape):
        json_files.read_notation(spark, str(tmp_path / "bad.json"))
    ledger = str(tmp_path / "ledger")
    assert {r[0] for r in json_files.read_ledger(spark, ledger, ["b", "a"]).collect()} == {"a", "b"}
    assert {r[0] for r in json_files.read_ledger(spark, ledger).collect()} == {"a", "b"}
    json_files.write_ledger(spark.createDataFrame([("z",), ("é",), ("z",), (None,)], "file_name string"), ledger)
    assert json.loads(spark.read.text(ledger).first()[0]) == ["z", "é"]
    assert json_files.query_list(spark, [("q", 50), ("r", 5)]).collect()[1][:] == (1, "r", 5)


def test_strict_rows_and_lists(spark, tmp_path):
    for name, value in (("ok", [{"case_id": "x", "input_variables": []}]), ("type", [{"case_id": 5}]), ("list", [{"input_variables": "t"}]), ("row", [1]), ("one", {"case_id": "x"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    read = lambda name, **k: json_files.read_json(spark, str(tmp_path / f"{name}.json"), json_files.TRAINING_CASE, **k)
    assert read("ok", strict=True).first()["case_id"] == "x"
    for name in ("type", "list", "row", "one"):
        with pytest.raises(json_files.WrongShape):
            read(name, strict=True)
    assert read("one").count() == 1 and read("one", lists_only=True).count() == 0


def test_generators_and_waits(spark):
    catalog, asked = spark.createDataFrame([("s__1", "d")], "model_id string, domain string"), []
    client = lambda prompt: asked.append(prompt) or '```json\n[{"case_id": "g", "correct_model_ids": ["s__1"]}]\n```'
    assert connectors.generate(spark, client, "Make cases.", json_files.CORE_CASE, catalog).first()["correct_model_ids"] == ["s__1"]
    assert asked == ['Make cases.\n{"model_id":"s__1","domain":"d"}']
    with pytest.raises(ValueError):
        connectors.generate(spark, client, "p", json_files.CORE_CASE, catalog, most=0)
    with pytest.raises(connectors.NotConfigured):
        connectors.generate(spark, None, "p", json_files.CORE_CASE)
    rows = spark.createDataFrame([(" ", "1"), ("f", "2")], "source_id string, eq_id string")
    assert {r["source_id"] for r in connectors.with_source(rows, "doc.pdf").collect()} == {"doc.pdf", "f"}
    states, slept = iter(["PROCESSING", "ACTIVE", "FAILED"]), []
    connectors.until_ready(lambda: next(states), sleep=slept.append)
    with pytest.raises(RuntimeError):
        connectors.until_ready(lambda: next(states), sleep=slept.append)
    now = iter([0.0, 5.0, 12.0])
    throttle = connectors.Throttle(12, lambda: next(now), slept.append)
    throttle.wait()
    throttle.wait()
    assert slept == [2.0, 7.0]
