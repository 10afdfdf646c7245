"""Stable identifiers, digests and hash-based order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioflow.storage import written

SEED = "42"


def digest(c: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def stable_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """prefix_ + digest of the parts joined by '|', with back slashes turned."""
    joined = F.concat_ws("|", *[F.replace(F.coalesce(p.cast("string"), F.lit("")), F.lit("\\"), F.lit("/")) for p in parts])
    return F.concat(F.lit(prefix + "_"), digest(joined, length))


def relative_path(path: Column) -> Column:
    """Forward slashes, leading dots and slashes stripped."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")


def file_id(dataset: Column, path: Column) -> Column:
    return F.concat(dataset, F.lit("_"), digest(F.concat_ws("|", dataset, relative_path(path)), 12))


def rank_key(key: Column, seed: str = SEED) -> Column:
    """Hexadecimal digest by which rows are drawn: the same in any order or layout."""
    return F.sha2(F.concat_ws("|", F.lit(seed), key.cast("string")), 256)


def hash_fraction(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1] from the first 32 bits of the rank key."""
    return F.conv(F.substring(rank_key(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def numbered_ids(df: DataFrame, scope: str, key: str, width: int = 6, label: str = "document_id") -> DataFrame:
    """(scope, key, label): ids by the rank of the sorted distinct keys within a scope, from 0.

    The rank comes from a range-partitioned sort with one offset per range, so
    a scope that holds most of the keys is spread over many tasks.  Null keys
    get no id.
    """
    keys = df.where(F.col(key).isNotNull() & F.col(scope).isNotNull()).select(scope, key).distinct()
    ranged = keys.repartitionByRange(scope, key).sortWithinPartitions(scope, key)
    ranged = written(ranged.select(scope, key, F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("_at")), "keys")
    parts = ranged.groupBy(scope, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    parts = parts.withColumn("_offset", F.sum("_n").over(W.partitionBy(scope).orderBy("_part")) - F.col("_n")).select(scope, "_part", "_first", "_offset")
    ranked = ranged.join(parts, [scope, "_part"]).withColumn("_rank", F.col("_offset") + F.col("_at") - F.col("_first"))
    return ranked.select(scope, key, F.format_string(f"%s_%0{width}d", F.col(scope), F.col("_rank")).alias(label))
