"""Names as identities: spelling-insensitive keys of datasets, groups and splits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Texts that stand for "no value", reduced to letters and digits.
NO_VALUE = (
    "", "na", "nan", "nil", "none", "null", "unknown", "unspecified", "undefined", "missing", "nodata", "novalue",
    "notavailable", "notapplicable", "tbd", "tba", "unk", "empty", "blank", "void", "notset", "unset", "noname", "nogroup", "notgiven", "unassigned",
    "keine", "leer", "unbekannt", "yok", "bilinmiyor",
)
# Spellings of the four splits, reduced to letters and digits.
SPLIT_SPELLINGS = {
    "train": ("train", "training", "trn"),
    "validation": ("validation", "valid", "val", "dev", "development"),
    "test": ("test", "testing", "tst"),
    "private_test": ("privatetest", "privatetesting", "testprivate"),
}
SPLITS = tuple(SPLIT_SPELLINGS)


def _absent(key: Column) -> Column:
    return F.when(~key.isin(*NO_VALUE), key)


def plain_name(c: Column) -> Column:
    """Letters and digits of ``c`` in lower case; NULL where it names nothing."""
    return _absent(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")))


def numbered_name(c: Column) -> Column:
    """Letters of ``c`` in lower case followed by the value of its number.

    ``X-0042`` and ``x42`` give ``x42``; NULL where the text names nothing,
    which is so for any text without a number.
    """
    key = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    letters = F.regexp_replace(key, r"\p{N}+", "")
    digits = F.regexp_replace(F.regexp_replace(key, r"[^\p{N}]+", ""), r"^0+(?=\p{N})", "")
    return F.when(digits != "", F.concat(letters, digits))


def split_name(c: Column) -> Column:
    """One of the four split names, or NULL."""
    key = plain_name(c)
    out = F.lit(None).cast("string")
    for name, spellings in SPLIT_SPELLINGS.items():
        out = F.when(key.isin(*spellings), F.lit(name)).otherwise(out)
    return out
