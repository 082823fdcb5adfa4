"""Texts that look the same in different characters, brought to one form."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equarry.operators.skew import salted_lookup, salted_pairs
from equarry.session import materialize

#: Letters that look like a Latin letter, and that letter.
LOOK_ALIKE = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "Ѵ": "V", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    # Greek
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Լ": "L",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ᏻ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T",
    "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # phonetic letters
    "ɡ": "g", "ɑ": "a",
}
#: Ranges of characters without ink or width.
NO_INK = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xE0000, 0xE0FFF))
#: Encodings of the hyphen, of a line's end, and units that decompose to letters and signs.
HYPHENS, LINE_ENDS, UNITS = "\u2010\u2011", "\u0085\u2028\u2029", "\u00b5\u2103\u2109"
#: Mappings of these kinds change how a character is encoded, not how it reads; raised, circled, styled ones and fractions stay.
KINDS = ("<wide>", "<narrow>", "<small>", "<noBreak>", "<square>")
#: No code point above this one has a mapping, but for the tags, which have no ink.
LAST = 0x2FFFF
#: Ranges of ideographs and syllables that stay as they are.
PLAIN = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x20000, 0x2F7FF))
#: Characters mapped at once; a longer text is mapped by itself.
CHARACTERS = 1 << 19
#: The look-alikes that words of another alphabet get back, by the first word of their characters' names.
BACK = {"CYRILLIC": "аеорсухАВЕКМНОРСТХУ", "GREEK": "ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"} | {a: "".join(c for c in LOOK_ALIKE if unicodedata.name(c).startswith(a)) for a in ("ARMENIAN", "CHEROKEE")}
ALPHABETS = ("LATIN", *BACK)
#: Hangul's leading, vowel and trailing letters and the first composed syllable.
LEADING, VOWEL, TRAILING, SYLLABLE = (0x1100, 19), (0x1161, 21), (0x11A7, 28), 0xAC00


def form_of(ch: str) -> str:
    """What a single character becomes before marks are ordered and recomposed."""
    code = ord(ch)
    if any(a <= code <= b for a, b in NO_INK):
        return ""
    if ch in HYPHENS:
        return "-"
    if ch in LINE_ENDS:
        return "\n"
    if unicodedata.category(ch) == "Zs":
        return " "
    if ch in LOOK_ALIKE:
        return LOOK_ALIKE[ch]
    parts = unicodedata.decomposition(ch).split()
    if not parts:
        return ch
    kind = parts.pop(0) if parts[0][0] == "<" else ""
    target = "".join(chr(int(p, 16)) for p in parts)
    joined = kind == "<compat>" and (ch in UNITS or "ROMAN NUMERAL" in unicodedata.name(ch, "") or len(target) > 1 and all(unicodedata.category(x)[0] == "L" for x in ch + target))
    return "".join(map(form_of, target)) if not kind or kind in KINDS or joined else ch


@lru_cache(1)
def tables() -> dict[str, np.ndarray]:
    """The mappings as arrays by code point: start and length of each target, combining class, alphabet, and pairs to compose."""
    codes = [chr(c) if not 0xD800 <= c <= 0xDFFF else "?" for c in range(LAST + 1)]
    start, length, flat = np.arange(LAST + 1, dtype=np.int32), np.ones(LAST + 1, np.int32), list(range(LAST + 1))
    alphabet = np.zeros(LAST + 1, np.int8)  # 0 no letter, 1.. one of ALPHABETS, -1 any other
    compose = {}
    for code, ch in enumerate(codes):
        if ch == "?" or any(a <= code <= b for a, b in PLAIN):
            alphabet[code] = -(ch != "?")
            continue
        if code < 0x80:
            pass
        elif (target := form_of(ch)) != ch:
            start[code], length[code] = len(flat), len(target)
            flat += map(ord, target)
        if ch.isalpha() and ch != "?":
            first = unicodedata.name(ch, "").split(" ")[0]
            alphabet[code] = ALPHABETS.index(first) + 1 if first in ALPHABETS else -1
        two = unicodedata.decomposition(ch).split()
        if len(two) == 2 and two[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            compose[int(two[0], 16) << 21 | int(two[1], 16)] = code
    marks = np.fromiter((unicodedata.combining(x) for x in codes), np.uint8, LAST + 1)
    back = np.tile(np.arange(128, dtype=np.uint32), (len(ALPHABETS) + 1, 1))
    for k, name in enumerate(ALPHABETS, 1):
        for c in BACK.get(name, ""):
            back[k, ord(LOOK_ALIKE[c])] = ord(c)
    keys = np.array(sorted(compose), np.int64)
    joins = np.zeros(LAST + 1, bool)
    joins[keys & (1 << 21) - 1] = True
    joins &= marks == 0
    return {"joins": joins, "start": start, "length": length, "flat": np.array(flat, np.uint32), "marks": marks, "alphabet": alphabet, "back": back, "keys": keys, "composed": np.array([compose[k] for k in keys.tolist()], np.uint32)}


def _back_by_word(code: np.ndarray, doc: np.ndarray, t: dict) -> np.ndarray:
    """Look-alikes of an alphabet get back into it in words that have letters of that alphabet alone and none that are purely
    Latin or of a third; in Russian also in lower-case words without either, in texts with more Cyrillic than Latin words,
    single letters only between spaces. All this depends on the look alone, so texts that look the same stay the same."""
    letter = t["alphabet"][code]
    there = np.bincount(letter[letter > 1], minlength=len(ALPHABETS) + 1)
    if not there.any():
        return code
    inside = (letter != 0) | (t["marks"][code] > 0)
    first = inside & ~np.r_[False, inside[:-1] & (doc[1:] == doc[:-1])]
    word = np.cumsum(first)
    n = int(word[-1]) + 1
    holds = lambda mask: np.bincount(word[inside & mask], minlength=n) > 0
    low, out = np.where(code < 128, code, 0), code
    for k in np.flatnonzero(there):
        either = (code < 128) & (t["back"][k][low] != low)
        own, latin, third = holds(letter == k), holds((letter == 1) & ~either), holds((letter != 0) & (letter != 1) & (letter != k))
        chosen = own & ~latin & ~third
        if ALPHABETS[k - 1] == "CYRILLIC":
            of_doc = np.zeros(n, np.int64)
            of_doc[word[first]] = doc[first]
            balance = np.bincount(of_doc, weights=(own & ~latin).astype(np.int64) - (latin & ~own).astype(np.int64))
            space = (code == 32) | (code == 10)
            edge = np.r_[True, doc[1:] != doc[:-1]]
            free = (edge | np.r_[True, space[:-1]]) & (np.r_[edge[1:], True] | np.r_[space[1:], True])
            single = np.bincount(word[inside], minlength=n) == 1
            tied = np.bincount(word[inside & ~free], minlength=n) > 0
            capital = holds(either & (code < 97))
            chosen |= ~own & ~latin & ~third & ~capital & (balance[of_doc] > 0) & ~(single & tied)
        out = np.where(inside & either & chosen[word], t["back"][k][low], out)
    return out


def _syllables(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Conjoining Hangul letters composed to syllables: a leading letter with a vowel, and those with a trailing letter."""
    is_in = lambda x, r: (x >= r[0]) & (x < r[0] + r[1])
    if not (is_in(code, VOWEL) | is_in(code, TRAILING)).any():
        return code, doc
    code = code.astype(np.int64)
    for pair in (0, 1):
        now, after, same = code[:-1], code[1:], doc[1:] == doc[:-1]
        open_ = (now >= SYLLABLE) & (now < SYLLABLE + 11172) & ((now - SYLLABLE) % TRAILING[1] == 0)
        hit = same & (is_in(now, LEADING) & is_in(after, VOWEL) if not pair else open_ & is_in(after, TRAILING) & (after > TRAILING[0]))
        made = SYLLABLE + ((now - LEADING[0]) * VOWEL[1] + after - VOWEL[0]) * TRAILING[1] if not pair else now + after - TRAILING[0]
        code[:-1] = np.where(hit, made, now)
        keep = np.r_[True, ~hit]
        code, doc = code[keep], doc[keep]
    return code, doc


def _composed(first: np.ndarray, second: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Where two characters compose, and to what."""
    pair = first.astype(np.int64) << 21 | second.astype(np.int64)
    at = np.minimum(np.searchsorted(t["keys"], pair), len(t["keys"]) - 1)
    return t["keys"][at] == pair, t["composed"][at]


def _letters_composed(code: np.ndarray, doc: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours without a combining class that compose, as some vowel signs do, the left of overlapping pairs first."""
    at = np.flatnonzero(t["joins"][np.minimum(code, LAST)])
    at = at[at > 0]
    if not len(at):
        return code, doc
    fits, made = _composed(code[at - 1], code[at], t)
    fits &= doc[at - 1] == doc[at]
    fits &= ~np.r_[False, fits[:-1] & (np.diff(at) == 1)]
    code, keep = code.copy(), np.ones(len(code), bool)
    code[at[fits] - 1] = made[fits]
    keep[at[fits]] = False
    return code[keep], doc[keep]


def _marks_composed(code: np.ndarray, doc: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Marks in the order of their class behind their base, and composed with it where nothing stands between."""
    mark = t["marks"][np.minimum(code, LAST)]
    some = np.flatnonzero((mark > 0) | np.r_[mark[1:] > 0, False])  # marks and what stands before the first of them
    if not len(some):
        return code, doc
    whole, kept = code.copy(), np.ones(len(code), bool)
    code, of, mark = code[some], doc[some], mark[some].astype(np.int64)
    segment = np.cumsum((mark == 0) | np.r_[True, of[1:] != of[:-1]])
    order = np.argsort(segment * 256 + mark, kind="stable")
    code, mark, segment = code[order], mark[order], segment[order]
    while True:
        first = np.r_[True, segment[1:] != segment[:-1]]
        base = np.flatnonzero(first)[np.cumsum(first) - 1]
        before = np.r_[0, mark[:-1]]
        fits, made = _composed(code[base], code, t)
        hit = np.flatnonzero(fits & ~first & (mark[base] == 0) & ((np.arange(len(code)) == base + 1) | (before < mark)))
        if not len(hit):
            break
        hit = hit[np.r_[True, segment[hit][1:] != segment[hit][:-1]]]
        code[base[hit]] = made[hit]
        kept[some[hit]] = False
        left = np.ones(len(code), bool)
        left[hit] = False
        code, mark, segment, some = code[left], mark[left], segment[left], some[left]
    whole[some] = code
    return whole[kept], doc[kept]


def canonical(texts: list[str]) -> list[str]:
    """The one form of each text, about CHARACTERS characters at once, which bounds what the arrays hold."""
    out, part, size = [], [], 0
    for x in texts:
        if part and size + len(x) > CHARACTERS:
            out += _forms(part)
            part, size = [], 0
        part.append(x)
        size += len(x)
    return out + _forms(part) if part else out


def _forms(texts: list[str]) -> list[str]:
    """The one form of each text.

    All texts are exploded to code points with their position and text; each code point is replaced by its mapping, marks
    are put in the order of their class behind their base, bases and marks are composed again, and strings rebuilt.
    """
    t = tables()
    texts = [x.replace("\r\n", "\n").replace("\r", "\n") for x in texts]
    sizes = np.array([len(x) for x in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), sizes)
    far = code > LAST
    low = np.where(far, 0, code)
    reps = np.where(far, 1, t["length"][low])
    reps[(code >= 0xE0000) & (code <= 0xE0FFF)] = 0
    offset = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    mapped = t["flat"][np.repeat(t["start"][low], reps) + offset]
    code, doc = np.where(np.repeat(far, reps), np.repeat(code, reps), mapped), np.repeat(doc, reps)
    safe = np.minimum(code, LAST)
    code = np.where(code > LAST, code, _back_by_word(safe, doc, t))
    code, doc = _syllables(code, doc)
    while True:
        n = len(code)
        code, doc = _letters_composed(*_marks_composed(code, doc, t), t)
        if len(code) == n:
            break
    ends = np.cumsum(np.bincount(doc, minlength=len(texts)))
    whole = code.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]


def _ranges(chars) -> str:
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


#: Characters that stay as they are in any text of which all others are such characters, too.
SETTLED = "\n\t" + "".join(c for c in map(chr, [*range(0x20, 0x250), *range(0x370, 0x400), *range(0x2012, 0x2028), *range(0x20A0, 0x20C0)]) if unicodedata.category(c) not in ("Cc", "Cf", "Cn") and unicodedata.normalize("NFC", form_of(c)) == c)
#: A character that isn't settled, ASCII letters, most of any text, being passed by the first part of the class alone; or a Greek
#: letter beside a Latin one that may be Greek, as such words may be put into one alphabet.
GREEK_LIKE = "".join(sorted(LOOK_ALIKE[c] for c in BACK["GREEK"]))
UNSETTLED = f"[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{{10ffff}}&&[^{_ranges([c for c in SETTLED if ord(c) > 0x7E])}]]|[\\x{{370}}-\\x{{3ff}}][A-Za-z\\x{{c0}}-\\x{{24f}}]|[A-Za-z\\x{{c0}}-\\x{{24f}}][\\x{{370}}-\\x{{3ff}}]"
#: Single characters that become another single settled one; the JVM replaces them.
SINGLE = {c: form_of(c) for c in map(chr, [0xA0, 0xB5, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x2010, 0x2011, 0x2126])}


def _single(c: Column) -> Column:
    return F.when(c.rlike(f"[\\x80-\\x{{10ffff}}&&[{_ranges(SINGLE)}]]"), F.translate(c, "".join(SINGLE), "".join(SINGLE.values()))).otherwise(c)


def _mapped(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(canonical(batch.column(2).to_pylist()), pa.string())], ["doc_id", "stored", "form"])


def text_forms(documents: DataFrame) -> DataFrame:
    """(doc_id, stored, form): the MD5 of each text as stored, and the text in its one form. Null and empty texts are left out.

    Texts of settled characters alone, most of them, stay in the JVM; the others are mapped in Arrow batches. A text is
    handled whole. Letters that look alike are written in Latin, in words of another alphabet in that one.
    """
    rows = documents.where("text <> ''").select("doc_id", F.md5("text").alias("stored"), _single(F.col("text")).alias("form"))
    other = F.col("form").rlike(UNSETTLED)
    return rows.where(~other).unionByName(rows.where(other).mapInArrow(_mapped, "doc_id bigint, stored string, form string"))


def same_looking(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), the smaller first: texts that aren't equal as stored but have the same form."""
    forms = materialize(text_forms(documents).select("doc_id", "stored", F.md5("form").alias("form")), "forms")
    groups = forms.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.min("stored").alias("a"), F.max("stored").alias("b")).where("a <> b").select("form", "n", F.col("n").alias("size"))
    members = materialize(salted_lookup(forms, groups, ["form"], "n", "doc_id"), "same")
    pairs = salted_pairs(members, "form", "doc_id", "size", ["stored"])
    return pairs.where("stored_a <> stored_b").select("doc_id_a", "doc_id_b")
