from equarry.llm import layouts

SCHEMA = "row_id bigint, context string, input_variables array<string>, output_variables array<string>, n int, c string"


def rows():
    return [
        (1, "Size the pump, at 85.4 J/G.", ["t_{in}", "G"], None, 1, "x"), (2, "size THE pump at (85.4) j g", ["G", "t_in", "", None, "G"], [], 2, "y"),
        (3, "size the pump at 85,4 J/g", ["t_in", "G"], [], 3, "z"), (4, "Size the pump at 85.4 J/G", ["g", "t_in"], [], 4, None), (5, "...", [], [], None, None),
        (6, None, ["a"], ["b"], None, None), (7, "size the pump at 85.4 J g", [], ["G", "t_in"], None, None), (8, "word " * 20000, None, None, None, None), (9, "WORD\t" * 20000, [], [], None, None),
    ]


def test_copies(spark):
    got = {r["row_id"]: r["first_row_id"] for r in layouts.layout_copies(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 7: 7, 8: 8, 9: 8}
    counts = layouts.copy_counts(layouts.layout_copies(spark.createDataFrame(rows(), SCHEMA)))
    assert {r["first_row_id"]: r["n_copies"] for r in counts.collect()}[1] == 2


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(layouts, "MASK", 0)
    got = {r["row_id"]: r["first_row_id"] for r in layouts.layout_copies(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 7: 7, 8: 8, 9: 8}


def test_empty(spark):
    assert layouts.layout_copies(spark.createDataFrame([], SCHEMA)).collect() == []
