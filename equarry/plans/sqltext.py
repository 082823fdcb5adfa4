"""Pieces of SQL (DuckDB's dialect) shared by the check queries."""

from __future__ import annotations

from equarry.functions.text import WHITE_SPACE

_CHARS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)


def trim(x: str) -> str:
    return f"trim({x}, {_CHARS})"


def filled(x: str) -> str:
    return f"nullif({trim(x)}, '')"


def items(x: str) -> str:
    """The trimmed, non-blank elements of a list."""
    return f"list_filter(list_transform(coalesce({x}, []), lambda e: {trim('e')}), lambda e: e is not null and e <> '')"


def global_key(source: str = "source_id", eq: str = "eq_id") -> str:
    return f"case when contains({filled(eq)}, '__') then {filled(eq)} else coalesce({filled(source)}, 'unknown') || '__' || {filled(eq)} end"
