"""Readers of the Parquet tables and the current-row view of a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_rows(df: DataFrame, key: str, columns: list[str], newest: tuple[str, ...] = ("recorded_at", "ingested_at")) -> DataFrame:
    """One row per ``key``: the one that is latest by ``newest``.

    Rows without a key name nothing and are left out.  Of rows that tie in all
    of ``newest``, the one with the largest values in column order is taken, so
    that reruns agree.  The aggregate combines on the map side, so a key with
    very many deliveries doesn't reach one task as rows.
    """
    picked = F.max(F.struct(*[F.col(c) for c in newest], *[F.col(c) for c in columns if c not in newest]))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(picked.alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])
