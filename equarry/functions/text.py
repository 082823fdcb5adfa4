"""Text expressions: trimming, keys, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space at the ends of a value.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

WORD = r"[\p{L}\p{N}]+"
TERM = r"[\p{L}\p{N}_]{2,}"


def clean(c: Column | str) -> Column:
    """c without white space at both ends; null stays null."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def norm(c: Column | str) -> Column:
    """Like clean, but null becomes the empty string."""
    return F.coalesce(clean(c), F.lit(""))


def filled(c: Column | str) -> Column:
    """The trimmed value, or null where it is blank."""
    return F.nullif(clean(c), F.lit(""))


def source_or_unknown(source: Column | str) -> Column:
    return F.coalesce(filled(source), F.lit("unknown"))


def global_key(source: Column | str, eq: Column | str) -> Column:
    """source__eq from trimmed parts; an eq that holds __ is the whole key; a blank eq gives null."""
    e = filled(eq)
    return F.when(e.contains("__"), e).otherwise(F.concat(source_or_unknown(source), F.lit("__"), e))


def catalog_key(source: Column | str, eq: Column | str) -> Column:
    """source__eq as stored, neither trimmed nor checked."""
    return F.concat(F.coalesce(source, F.lit("")), F.lit("__"), F.coalesce(eq, F.lit("")))


def filled_items(items: Column | str) -> Column:
    """The trimmed, non-blank elements of an array, in order; a null array is an empty one."""
    kept = F.filter(F.transform(items, clean), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def words(c: Column) -> Column:
    """The longest runs of letters or digits, in lower case, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def terms(c: Column) -> Column:
    """Tokens of two or more letters, digits or underscores, in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TERM), F.lit(0))


def replace_in_order(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Literal replacements one after the other; an earlier rule's result is seen by the later ones."""
    for old, new in rules:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c
