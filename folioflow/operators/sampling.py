"""Deterministic samples by hash: top-k per stratum, round robin, quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from folioflow.functions.ids import rank_key


def ranked(rows: DataFrame, strata: list[str], key: str, seed: str = "42", name: str = "rank_in_stratum") -> DataFrame:
    """Rows numbered from 1 within their stratum by the hash of ``key``."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*strata).orderBy(rank_key(F.col(key), seed), key)))


def smoke(rows: DataFrame, strata: list[str], key: str, k: int, seed: str = "42") -> DataFrame:
    """The first k rows of every stratum; Spark prunes within tasks before it shuffles."""
    return ranked(rows, strata, key, seed).where(F.col("rank_in_stratum") <= k)


def round_robin(rows: DataFrame, strata: list[str], key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows, taken in turn from each stratum; no stratum can give more than n."""
    return smoke(rows, strata, key, n, seed).orderBy("rank_in_stratum", *strata).limit(n)


def apportion(sizes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """(key, quota): largest-remainder shares of ``total`` in proportion to ``size``.

    One row per stratum; ties of remainders go to the larger size, then the key.
    """
    whole = sizes.select(F.sum(size).alias("_all"))
    s = sizes.crossJoin(F.broadcast(whole)).withColumn("_exact", F.col(size) * F.lit(float(total)) / F.col("_all")).withColumn("quota", F.floor("_exact"))
    left = F.lit(total) - F.sum("quota").over(W.partitionBy())
    place = F.row_number().over(W.orderBy(F.desc(F.round(F.col("_exact") - F.col("quota"), 12)), F.desc(size), key))
    return s.withColumn("_left", left).withColumn("_place", place).select(key, size, (F.col("quota") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)).cast("bigint").alias("quota"))


def proportional(rows: DataFrame, stratum: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows in proportion to the strata's sizes, within each by hash."""
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    quota = apportion(sizes, stratum, "size", n).select(F.col(stratum).alias("_s"), "quota")
    return smoke(rows, [stratum], key, n, seed).join(quota, F.col(stratum).eqNullSafe(F.col("_s"))).where(F.col("rank_in_stratum") <= F.col("quota")).drop("_s")


def weighted(rows: DataFrame, stratum: str, key: str, n: int, weights: dict[str, float], seed: str = "42") -> DataFrame:
    """n rows by fixed weights of strata, filled up by hash where a stratum falls short."""
    w = rows.sparkSession.createDataFrame([(s, max(1, int(round(n * x)))) for s, x in weights.items()], "_s string, _k int")
    r = ranked(rows, [stratum], key, seed).join(F.broadcast(w), F.col(stratum) == F.col("_s"), "left")
    filled = F.when(F.col("rank_in_stratum") <= F.col("_k"), 0).otherwise(1)
    return r.withColumn("_fill", filled).orderBy("_fill", rank_key(F.col(key), seed), key).limit(n).drop("_s", "_k", "_fill")


def unique_first(rows: DataFrame, digest: str, key: str, seed: str = "42") -> DataFrame:
    """Adds is_unique: the first row by hash of each digest."""
    first = rows.groupBy(digest).agg(F.min_by(key, F.struct(rank_key(F.col(key), seed), key)).alias("_first"))
    return rows.join(first, digest, "left").withColumn("is_unique", F.col("_first").eqNullSafe(F.col(key))).drop("_first")
