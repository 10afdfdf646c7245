"""Reproducible samples that only grow: golden-ratio low-discrepancy selection."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioflow.functions.names import plain_name
from folioflow.sources.tables import table
from folioflow.storage import Versions, shared_dir, written

#: floor(2**48 / golden ratio), made odd: multiples modulo 2**48 are the
#: fractional multiples of the golden ratio in 48-bit fixed point.
STEP = 173961102589771
ONE = 1 << 48
HALF = 1 << 24
SHIFT = 0.3819  # the fixed shift; drawn once, never changed


def golden_fraction(number: Column, shift: float = SHIFT) -> Column:
    """frac(number * golden ratio + shift) of a non-negative integer, exactly.

    The product modulo 2**48 is put together from 24-bit halves, so it neither
    overflows nor depends on floating point.
    """
    n = F.pmod(number.cast("bigint"), F.lit(ONE))
    hi, lo = F.floor(n / F.lit(float(HALF))).cast("bigint"), n % F.lit(HALF)
    s_hi, s_lo = STEP // HALF, STEP % HALF
    cross = (hi * F.lit(s_lo) + lo * F.lit(s_hi)) % F.lit(HALF)
    product = (cross * F.lit(HALF) + lo * F.lit(s_lo)) % F.lit(ONE)
    return ((product + F.lit(int(shift * ONE))) % F.lit(ONE)) / F.lit(float(ONE))


def key_number(key: Column) -> Column:
    """The persistent number of a record: 48 bits of the digest of its key.

    For populations without a stored table of numbers: it belongs to the key
    alone, so it survives any growth, but the coverage is that of a hash.
    """
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 12), 16, 10).cast("bigint")


def extend_numbers(records: DataFrame, key: str, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """(key, number): a table of dense persistent numbers, kept and extended.

    Keys in ``known`` keep their number; new keys follow after the largest one,
    ordered by ``order`` (its first values of a key) and then by key.  Dense
    numbers make the golden-ratio selection even in every stretch of arrivals.
    Numbers come from a range-partitioned sort with one offset per partition,
    so no single task ranks all records.  Null keys get no number.
    """
    last = None if known is None else known.agg(F.max("number")).first()[0]
    fresh = _fresh_numbers(records, key, order, known, 0 if last is None else last + 1)
    return fresh if known is None else known.select(key, "number").unionByName(fresh)


def _fresh_numbers(records: DataFrame, key: str, order: list[str], known: DataFrame | None, start: int) -> DataFrame:
    fresh = records.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(c).alias(c) for c in order])
    if known is not None:
        fresh = fresh.join(known.select(key), key, "left_anti")
    ranged = fresh.repartitionByRange(*order, key).sortWithinPartitions(*order, key).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % F.lit(1 << 33))
    ranged = written(ranged.select(key, "_part", "_at"), "numbers")
    sizes = ranged.groupBy("_part").count().orderBy("_part").collect()  # one row per partition
    offsets, at = [], start
    for r in sizes:
        offsets.append((r["_part"], at))
        at += r["count"]
    off = F.broadcast(records.sparkSession.createDataFrame(offsets or [(-1, 0)], "_part int, _offset long"))
    return ranged.join(off, "_part").select(key, (F.col("_offset") + F.col("_at")).alias("number"))


class NumberTable:
    """The stored sequence numbers of a population, added to by every call of :meth:`extend`.

    Each call appends the numbers of the keys that are new and commits a
    version; a key keeps its number for good, whatever comes later.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.store = Versions(spark, path)

    def extend(self, records: DataFrame, key: str, order: list[str]) -> DataFrame:
        """(key, number) of all keys known after taking in ``records``."""
        version = self.store.newest()
        known, start = self.store.table("numbers", version), self.store.read(version)["facts"].get("next", 0)
        fresh = written(_fresh_numbers(records, key, order, known, start), "fresh")
        n = fresh.count()
        if n or not version:
            version = self.store.add({"numbers": fresh}, {"next": start + n}, version)
        return self.store.table("numbers", version).select(key, "number")


def numbers_of(spark: SparkSession, sf_dir: str, name: str) -> NumberTable:
    """The stored numbers of a table at its place, in the shared folder."""
    place = hashlib.sha256(sf_dir.rstrip("/").encode()).hexdigest()[:16]
    return NumberTable(spark, f"{shared_dir(spark)}/sequence-numbers/{name}-{place}")


def golden_sample(records: DataFrame, number: Column, rate: float, shift: float = SHIFT) -> DataFrame:
    """Rows whose golden-ratio fraction lies in the fixed interval [0, rate).

    Whether a row is taken depends on its own number only, so reruns, other
    partitionings and added rows change nothing for it; with a larger ``rate``
    the sample grows and keeps its members.  NULL numbers are never taken.
    """
    return records.where(golden_fraction(number, shift) < F.lit(float(rate)))


RATE = 0.10


def sampled(records: DataFrame, key: str, order: list[str], numbers: NumberTable, rate: float = RATE) -> DataFrame:
    """The keys of ``records`` that are in the sample; records that are new get their number first."""
    numbered = numbers.extend(records, key, order)
    here = records.where(F.col(key).isNotNull()).select(key).distinct()
    return golden_sample(numbered.join(here, key, "left_semi"), F.col("number"), rate).select(key)


def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the files of raw_baseline over all runs, one row per file.

    A file counts once however often and however it is recorded, and is
    numbered by the run that recorded it first; its digest isn't part of the
    choice, because a later run may be the first to record it.
    """
    files = table(spark, sf_dir, "raw_baseline").where(plain_name(F.col("file_id")).isNotNull()).select("file_id", "baseline_run")
    return sampled(files, "file_id", ["baseline_run"], numbers_of(spark, sf_dir, "raw_baseline"))


def p4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the pages of validation, one row per page, numbered by their first day in the manifest."""
    pages = table(spark, sf_dir, "validation").where("page_id is not null").select("page_id", F.to_date("ingested_at").alias("day"))
    return sampled(pages, "page_id", ["day"], numbers_of(spark, sf_dir, "validation"))


def _oracle(name: str, key: str, order: str) -> str:
    return f"""WITH n AS (SELECT {key}, row_number() OVER (ORDER BY min({order}) NULLS FIRST, {key}) - 1 AS number FROM {name} WHERE {key} IS NOT NULL GROUP BY {key})
      SELECT {key} FROM n WHERE ((number::HUGEINT * {STEP} + {int(SHIFT * ONE)}) % {ONE})::DOUBLE / {float(ONE)} < {RATE}"""


QUERIES = {"p4_files": p4_files, "p4_pages": p4_pages}
ORACLES = {"p4_files": _oracle("raw_baseline", "file_id", "baseline_run"), "p4_pages": _oracle("validation", "page_id", "ingested_at::DATE")}
