"""Sinks: tables, reports and content-addressed caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

RAW_MARK = "data/raw"


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, NaN and infinities as NULL: fit for CSV."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def refuse_raw(path: str) -> str:
    if RAW_MARK in path.replace("\\", "/"):
        raise ValueError("results are never written below the raw tree")
    return path


def require_below(path: str, root: str) -> str:
    """The path, if it lies below ``root`` (a private root, say)."""
    p, r = (x.replace("\\", "/").rstrip("/") for x in (path, root))
    if ".." in p.split("/") or not p.startswith(r + "/"):
        raise ValueError("private results have to be written below the private root")
    return path


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    flat(df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(refuse_raw(path))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, on purpose."""
    return spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    df.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in nested}).write.mode("overwrite").json(refuse_raw(path))


def write_parts(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(refuse_raw(path))


def cache_put(df: DataFrame, path: str, digest: str, private: str) -> int:
    """Append rows that the cache hasn't, sharded by the digest's first two digits; private rows never.

    Returns how many were new.  A digest already there isn't written again, so
    a repeated put changes nothing.
    """
    spark = df.sparkSession
    public = df.where(~F.coalesce(F.col(private), F.lit(True))).dropDuplicates([digest]).drop(private).withColumn("shard", F.substring(digest, 1, 2))
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        public = public.join(spark.read.parquet(path).select(digest), digest, "left_anti")
    public = public.cache()
    n = public.count()
    if n:
        public.repartition("shard").write.mode("append").partitionBy("shard").parquet(refuse_raw(path))
    public.unpersist()
    return n


def cache_get(spark: SparkSession, path: str, keys: DataFrame, digest: str) -> DataFrame:
    return keys.select(digest).distinct().join(spark.read.parquet(path).drop("shard"), digest)
