"""The SQL twins of :mod:`folioflow.functions.names`, for DuckDB."""

from __future__ import annotations

from folioflow.functions.names import NO_VALUE, SPLIT_SPELLINGS

_NONE = ", ".join(f"'{x}'" for x in NO_VALUE)


def _key(c: str) -> str:
    return rf"lower(regexp_replace({c}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"


def plain(c: str) -> str:
    return f"(CASE WHEN {_key(c)} NOT IN ({_NONE}) THEN {_key(c)} END)"


def numbered(c: str) -> str:
    letters = rf"regexp_replace({_key(c)}, '\p{{N}}+', '', 'g')"
    digits = rf"regexp_replace(regexp_replace({_key(c)}, '[^\p{{N}}]+', '', 'g'), '^0+(\p{{N}})', '\1')"
    return f"(CASE WHEN {digits} <> '' THEN {letters} || {digits} END)"


def split(c: str) -> str:
    whens = " ".join(f"WHEN {_key(c)} IN ({', '.join(repr(x) for x in xs)}) THEN '{name}'" for name, xs in SPLIT_SPELLINGS.items())
    return f"(CASE {whens} END)"


def current(table: str, key: str) -> str:
    return f"(SELECT * FROM {table} WHERE {key} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY recorded_at DESC, ingested_at DESC) = 1)"
