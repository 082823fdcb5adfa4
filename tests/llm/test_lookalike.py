import unicodedata

from equarry.llm import lookalike as L

SAME = [
    ("Flow rate (m)", "Ｆｌｏｗ　rate （m）"), ("naïve café", "naïve café"), ("a b", "a b"), ("office", "oﬃce"), ("zero", "ze​⁠ro﻿"),
    ("soft", "so­ft"), ("Tower", "Тоwеr"), ("x-ray", "x‑ray"), ("5 Ω", "5 Ω"), ("3 µm", "3 μm"), ("10 Å", "10 Å"), ("K", "K"), ("a\nb", "a\r\nb"), ("ёж", "ёж"),
    ("ạ́", "ạ́"), ("сор", "cop"), ("вода стоп", "вoдa cтoп"),
]
DIFFERENT = [("m2", "m²"), ("A", "a"), ("cafe", "café"), ("a-b", "a–b"), ("a b", "a  b"), ("a, b", "a; b"), ("и", "й"), ("a b", "a\nb"), ("½", "1/2")]


def test_same_and_different():
    for a, b in SAME:
        assert L.canonical([a]) == L.canonical([b]), (a, b)
    for a, b in DIFFERENT:
        assert L.canonical([a]) != L.canonical([b]), (a, b)


def test_batch_equals_single_and_twice_is_once():
    texts = [x for pair in SAME + DIFFERENT for x in pair] + ["", "́alone", "word " * 5000, "\U0001f600 \U000e0041x", "한국어 ไทย"]
    many = L.canonical(texts)
    assert many == [L.canonical([t])[0] for t in texts] == L.canonical(many)


def test_marks_as_in_the_standard():
    for t in ["ạ́b", "ế", "q̣̇", "Ǻ", "ǖ", "à֮̕b"]:
        assert L.canonical([t])[0] == unicodedata.normalize("NFC", t)


def test_russian_stays_cyrillic():
    assert L.canonical(["Поток с насосом, 19.3 kg/h, х и y"])[0].startswith("Поток с насосом, 19.3 kg/h")


def test_pairs(spark):
    rows = [(1, "café", "x"), (2, "café", "x"), (3, "café", "x"), (4, None, "x"), (5, "", "x"), (6, "cafe", "x"), (7, "​", "x"), (8, "⁠", "x"), (9, "plain text", "x"), (10, "plain text", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form string")
    assert {tuple(r) for r in L.same_looking(df).collect()} == {(1, 2), (2, 3), (7, 8), (9, 10)}
    assert L.same_looking(df.limit(0)).collect() == []
    forms = {r["doc_id"]: r["form"] for r in L.text_forms(df).collect()}
    assert forms[2] == "café" and forms[10] == "plain text" and sorted(forms) == [1, 2, 3, 6, 7, 8, 9, 10]


def test_all_code_points_as_in_the_standard():
    """A code point that isn't mapped otherwise than by its canonical decomposition has the form NFC gives it, on every plane."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and chr(c) != "\r"]
    kept = [c for c in chars if L.form_of(c) == unicodedata.normalize("NFD", c) or (unicodedata.category(c) == "Lo" and 0xAC00 <= ord(c) <= 0xD7A3)]
    assert len(kept) > 1_000_000 and "\U0002f800" in kept
    got = L.canonical(["\n".join(kept)])[0].split("\n")
    want = unicodedata.normalize("NFC", "\n".join(kept)).split("\n")
    assert [a for a, b in zip(got, want) if a != b] == [] and len(got) == len(want)


def test_hangul_letters_are_composed():
    for t in ("한국어 가각힣", "\u1112\u1161\u11ab\u1100\u116e\u11a8", "\uac00\u11a8", "\u1100\n\u1161", "\u1161\u11a8", "\u1100\u1161\u11a7"):
        assert L.canonical([t])[0] == L.canonical([unicodedata.normalize("NFD", t)])[0] == unicodedata.normalize("NFC", t)


def test_words_of_other_alphabets_stay_whole():
    for t in ("Νερό και φως", "Вода", "ջուր", "ΔΤ = λ"):
        assert L.canonical([t])[0] == t
    assert L.canonical(["Nερό"]) == L.canonical(["Νερό"]) and L.canonical(["ΔT"]) == L.canonical(["ΔΤ"])
    assert L.canonical(["\u0261\u0578\u0585\u03bd\u13aa \u2162"])[0] == "gnovA III"
    assert L.canonical(["λx μm"])[0] == "λx μm"


def test_settled_texts_need_no_mapping(spark):
    """What stays in the JVM is what the mapping leaves as it is."""
    texts = ["ΔT of 5", "λ o", "ρ g h", "Tλ", "μm and μM", "a\tb", "é λ", "Ο", "x_ν"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    settled = {r[0] for r in df.where(~df.t.rlike(L.UNSETTLED)).collect()}
    assert settled == {"λ o", "ρ g h", "a\tb", "é λ"} and all(L.canonical([t])[0] == t for t in settled)
