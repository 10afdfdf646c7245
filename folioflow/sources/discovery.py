"""Finding datasets in a listing, settings, and drift between manifests and examples."""

from __future__ import annotations

import copy
from collections.abc import Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def settings(defaults: Mapping, *patches: Mapping) -> dict:
    """Defaults with patches merged in, object by object."""
    out = copy.deepcopy(dict(defaults))
    for patch in patches:
        for k, v in patch.items():
            out[k] = settings(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def name_filter(values: str | list[str] | None) -> list[str] | None:
    """Lower-case names of a comma list; None (no filter) where it names none."""
    parts = (values if isinstance(values, list) else (values or "").split(",")) if values is not None else []
    return sorted({p.strip().lower() for p in parts if p.strip()}) or None


def only(column: Column, names: list[str] | None) -> Column:
    return F.lit(True) if names is None else F.lower(column).isin(*names)


def discover(paths: DataFrame, path: str, root: Column, signatures: dict[str, dict], most: int = 50) -> DataFrame:
    """(root, dataset, confidence, files): a marker path tells surely, a name with suffixes fairly, else low.

    ``signatures``: dataset -> {"markers": [...], "names": [...], "suffixes": [...]}.
    The suffix count stops at ``most``; every listed path is read once.
    """
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    rows = paths.select(root.alias("root"), low.alias("p"), F.lower(root).alias("r"))
    anyof = lambda c, xs: reduce(lambda a, b: a | b, [F.contains(c, F.lit(x.lower())) for x in xs], F.lit(False))
    aggs = []
    for d, s in signatures.items():
        ends = reduce(lambda a, b: a | b, [F.endswith(F.col("p"), F.lit(x)) for x in s.get("suffixes", [])], F.lit(False))
        aggs.append(F.struct(F.lit(d).alias("dataset"), F.max(anyof(F.col("p"), s.get("markers", []))).alias("marked"), F.max(anyof(F.col("r"), s.get("names", []))).alias("named"), F.least(F.count_if(ends), F.lit(most)).alias("files")).alias(d))
    found = rows.groupBy("root").agg(*aggs).select("root", F.explode(F.array(*signatures)).alias("x")).select("root", "x.*")
    return found.select("root", "dataset", F.when(F.col("marked"), "high").when(F.col("named") & (F.col("files") > 0), "medium").otherwise("low").alias("confidence"), "files")


def native_splits(parts: dict[str, DataFrame], stem: str) -> DataFrame:
    """(stem, split) of several split lists; a later list wins."""
    every = reduce(DataFrame.unionByName, [d.select(F.col(stem).alias("stem"), F.lit(s).alias("split"), F.lit(i).alias("i")) for i, (s, d) in enumerate(parts.items())])
    return every.groupBy("stem").agg(F.max_by("split", "i").alias("split"))


def drifted(manifest: DataFrame, examples: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column): where an example differs from its manifest row, or is missing."""
    m, e = manifest.alias("m"), examples.alias("e")
    j = m.join(e, F.col(f"m.{key}") == F.col(f"e.{key}"), "left")
    differs = F.array_compact(F.array(F.when(F.col(f"e.{key}").isNull(), F.lit("(missing)")), *[F.when(F.col(f"e.{key}").isNotNull() & ~F.col(f"m.{c}").eqNullSafe(F.col(f"e.{c}")), F.lit(c)) for c in columns]))
    return j.select(F.col(f"m.{key}").alias(key), F.explode(differs).alias("column"))


def newest(files: DataFrame, n: int = 250) -> DataFrame:
    """The n newest result files, before anything else is filtered out."""
    return files.orderBy(F.desc("modificationTime"), "path").limit(n)


def decode_source(content: Column) -> Column:
    """UTF-8 text without a byte order mark; windows-1252 where it isn't UTF-8."""
    @F.pandas_udf(T.StringType())
    def western(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else bytes(b).decode("cp1252", "replace"))

    ok = F.is_valid_utf8(content.cast("string"))
    return F.regexp_replace(F.when(ok, content.cast("string")).otherwise(western(F.when(~ok, content))), "^﻿", "")
