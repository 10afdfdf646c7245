"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: The keys treated as hot are the HOT most frequent ones: a bound that does
#: not grow with the data.  Any other key holds less than 1/(HOT+1) of the rows.
HOT = 64
SALTS = 32


def hot_keys(df: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """The ``hot`` keys most frequent in a sixteenth of the rows (at most ``hot`` rows).

    The choice only steers where rows go, never which rows there are.  Rows are
    drawn by their hash, so every evaluation finds the same keys.
    """
    drawn = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(16)) == 0
    return (
        df.where(F.col(key).isNotNull() & drawn).groupBy(F.col(key).alias("_hot_key")).agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), "_hot_key").limit(hot).select("_hot_key")
    )


def lookup_join(
    df: DataFrame, key: str, lookup: DataFrame, lookup_key: str, how: str = "left", salt: Column | None = None, hot: int = HOT
) -> DataFrame:
    """``df`` joined with ``lookup`` (unique by ``lookup_key``), hot keys salted.

    ``df`` is read twice, so it should be a written table or a cheap scan.  Rows
    of a hot key are spread over SALTS partitions and its single lookup row is
    repeated that often; a null key matches nothing.  ``lookup_key`` is dropped.
    """
    top = F.broadcast(hot_keys(df, key, hot))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SALTS)) if salt is None else salt
    left = (
        df.join(top, F.col(key) == F.col("_hot_key"), "left")
        .withColumn("_salt", F.when(F.col("_hot_key").isNull(), F.lit(0)).otherwise(salt).cast("int")).drop("_hot_key")
    )
    right = (
        lookup.withColumnRenamed(lookup_key, "_lookup_key")
        .join(top, F.col("_lookup_key") == F.col("_hot_key"), "left")
        .withColumn("_lookup_salt", F.explode(F.when(F.col("_hot_key").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        .drop("_hot_key")
    )
    return left.join(right, (F.col(key) == F.col("_lookup_key")) & (F.col("_salt") == F.col("_lookup_salt")), how).drop(
        "_salt", "_lookup_key", "_lookup_salt"
    )


def pairs_join(left: DataFrame, right: DataFrame, key: str, hot_of: DataFrame, salt: Column, hot: int = HOT) -> DataFrame:
    """All pairs of ``left`` and ``right`` rows of equal ``key`` (which both have), hot keys spread.

    The hottest keys of ``hot_of`` (a written table with ``key``) are told to
    both sides: their left rows are spread over SALTS partitions by ``salt``
    and their right rows repeated there, so no task meets a whole hot key.
    Columns of the two sides need different names but for ``key``.
    """
    top = F.broadcast(hot_keys(hot_of, key, hot))
    is_hot = F.col("_hot_key").isNotNull()
    a = left.join(top, F.col(key) == F.col("_hot_key"), "left").withColumn("_salt", F.when(is_hot, salt).otherwise(F.lit(0)).cast("int")).drop("_hot_key")
    b = right.join(top, F.col(key) == F.col("_hot_key"), "left").withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot_key")
    return a.join(b, [key, "_salt"]).drop("_salt")


def with_group_min(df: DataFrame, key: str, value: str, distinct: bool = False, hot: int = HOT) -> DataFrame:
    """``df`` with ``least`` (the smallest ``value``) and ``n`` (the rows) of each row's group, in one exchange.

    Groups of the hottest keys are spread over SALTS partitions; their figures
    come from an aggregate (at most ``hot`` rows, sent to every task).  Any
    other group holds less than 1/(hot+1) of the rows and is a window of its
    partition.  ``distinct`` drops repeated (key, value) rows on the way, of
    which ``n`` counts the remaining ones only for groups that aren't hot.
    ``df`` is read three times, so it should be cheap; null keys are one group.
    """
    top = hot_keys(df, key, hot)
    flagged = df.join(F.broadcast(top), F.col(key) == F.col("_hot_key"), "left")
    salt = F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int")
    spread = flagged.withColumn("_salt", F.when(F.col("_hot_key").isNull(), F.lit(0)).otherwise(salt)).repartition(key, "_salt")
    if distinct:
        spread = spread.dropDuplicates([key, "_salt", value])
    part = W.partitionBy(key, "_salt")
    spread = spread.withColumns({"_least": F.min(value).over(part), "_n": F.count(F.lit(1)).over(part)})
    whole = df.join(F.broadcast(top), F.col(key) == F.col("_hot_key")).groupBy(F.col("_hot_key").alias("_k")).agg(F.min(value).alias("_hot_least"), F.count(F.lit(1)).alias("_hot_n"))
    out = spread.join(F.broadcast(whole), F.col(key) == F.col("_k"), "left")
    return out.select(*df.columns, F.coalesce("_hot_least", "_least").alias("least"), F.coalesce("_hot_n", "_n").alias("n"))
