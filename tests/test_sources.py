import json

import pytest

from equarry.operators.corpus import papers
from equarry.operators.orphans import OrphanTracker
from equarry.sources import connectors, json_files, sinks
from equarry.streaming.ingest import ingest, track_orphans

RECORD = {"source_id": "s", "eq_id": "1", "equation": "x", "variables": {"x": "d"}, "context_text": "c", "domain": "é"}


def test_json_dialects(spark, tmp_path):
    texts = [json.dumps([RECORD]), json.dumps({"equations": [RECORD]}), json.dumps({"papers": [RECORD]}), json.dumps(RECORD), "```json\n" + json.dumps([RECORD]) + "\n```", "no json", "[]"]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    rows = json_files.records(df, json_files.EQUATION).collect()
    assert len(rows) == 5 and all(r["variables"] == {"x": "d"} and r["domain"] == "é" for r in rows)
    (tmp_path / "a.json").write_text(texts[1])
    assert json_files.read_json(spark, str(tmp_path / "a.json"), json_files.EQUATION).count() == 1
    with pytest.raises(json_files.WrongShape):
        json_files.read_json(spark, str(tmp_path / "a.json"), json_files.EQUATION, strict=True)
    assert json_files.read_json(spark, str(tmp_path / "none.json"), json_files.EQUATION, missing_is_empty=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        json_files.read_json(spark, str(tmp_path / "none.json"), json_files.EQUATION)


def test_ledger_and_files(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"processed": ["b.pdf", "a.pdf", "a.pdf"]}')
    assert {r[0] for r in json_files.read_ledger(spark, str(tmp_path / "l.json")).collect()} == {"a.pdf", "b.pdf"}
    assert {r[0] for r in json_files.read_ledger(spark, str(tmp_path / "m.json"), ["z.pdf"]).collect()} == {"z.pdf"}
    (tmp_path / "x.pdf").write_bytes(b"1")
    (tmp_path / "y.txt").write_bytes(b"1")
    assert [r["file_name"] for r in json_files.list_files(spark, str(tmp_path)).collect()] == ["x.pdf"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", 0.5)], "a int, b string, c double")
    sinks.write_version(df, str(tmp_path / "t"))
    assert not sinks.append_if_any(df, df.limit(0), str(tmp_path / "t")) and sinks.current_version(spark, str(tmp_path / "t")) == 1
    assert sinks.append_if_any(sinks.read_version(spark, str(tmp_path / "t")), df, str(tmp_path / "t")) and sinks.read_version(spark, str(tmp_path / "t")).count() == 2
    sinks.write_json_array(df, str(tmp_path / "o.json"))
    assert json.loads((tmp_path / "o.json").read_text()) == [{"a": 1, "b": "é", "c": 0.5}] and "é" in (tmp_path / "o.json").read_text()
    assert sinks.derived_path("/x/eq.json") == "/x/eq_normalized.json" and "| 1 | é | 0.5000 |" in sinks.markdown_table(df, "c")


def test_connectors(spark):
    text = "```json\n" + json.dumps(RECORD) + "\n```"

    def client(path, content):
        if path == "bad":
            raise RuntimeError("quota")
        return text

    files = spark.createDataFrame([("good", bytearray(b"x")), ("bad", bytearray(b"y"))], "path string, content binary")
    rows, failed = connectors.extract(files, client, json_files.EQUATION)
    assert rows.count() == 1 and [r["path"] for r in failed.collect()] == ["bad"]
    with pytest.raises(connectors.NotConfigured):
        connectors.extract(files, None, json_files.EQUATION)
    with pytest.raises(connectors.NotConfigured):
        connectors.key_from("EQUARRY_NO_SUCH_KEY")
    assert list(connectors.waits(2, 10, 4)) == [2, 4, 8, 10] and connectors.rate_limited(None, "Rate limit") and not connectors.rate_limited(404)
    calls, slept = [], []

    def fetch(q, limit, offset):
        calls.append(offset)
        if len(calls) == 1:
            raise connectors.RateLimited
        return {"data": [{"paperId": f"{q}{offset + i}"} for i in range(limit)]} if offset < 4 else {"data": []}

    assert len(connectors.paged(fetch, "q", 10, 2, slept.append)) == 4 and slept == [60]


def test_papers(spark):
    found = [("a", [{"paperId": "p1", "openAccessPdf": {"url": "u"}}, {"paperId": "p2", "openAccessPdf": ""}]), ("b", [{"paperId": "p2", "openAccessPdf": "v"}, {"paperId": None}, {"paperId": "p3", "openAccessPdf": {"status": "x"}}])]
    got = {r["paper_id"]: (r["query"], r["has_pdf"]) for r in papers(connectors.papers_frame(spark, found)).collect()}
    assert got == {"p1": ("a", True), "p2": ("a", True), "p3": ("b", False)}


def test_streams(spark, tmp_path):
    schema = "row_id bigint, source_id string, eq_id string"
    run = lambda: ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state"), ["source_id", "eq_id"])
    for k, rows in enumerate([[(1, "s", "1"), (2, "s", "1")], None, [(3, "s", "1"), (4, "s", "2"), (5, None, "2")]]):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
        assert sinks.read_deltas(spark, str(tmp_path / "out")).count() == (1, 1, 3)[k]
    case = "row_id bigint, created_at timestamp_ntz, correct_model_ids array<string>"
    tracker = OrphanTracker(spark, str(tmp_path / "orphans"))
    for i in (1, 2):
        spark.sql(f"select {i}L row_id, timestamp_ntz'2024-01-01 00:00:00' created_at, array('a__{i}') correct_model_ids").coalesce(1).write.mode("append").parquet(str(tmp_path / "cases"))
        track_orphans(spark, str(tmp_path / "cases"), case, tracker, str(tmp_path / "cstate"))
    assert tracker.refs().count() == 2
