"""Shared intermediate storage, and versioned tables that outlive a session.

Iterative operators cut their lineage by writing a Parquet table into the
folder named by ``spark.checkpoint.dir``; every executor can read it, so the
loss of an executor costs nothing.  Parquet is several times smaller than a
serialised RDD checkpoint.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's ``spark.checkpoint.dir``.

    On one machine (``local`` masters, as in tests) a temporary folder is chosen
    where that is unset; on a cluster a folder of one machine would be of no use
    to the executors, so that is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    own = spark.conf.get("folioflow.shared.dir", None)
    if not own:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors can read")
        own = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set("folioflow.shared.dir", own)
    return own.rstrip("/")


def path_for(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _filesystem(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written table.

    The table is deleted by :func:`drop_written` or else when the driver ends.
    """
    spark = df.sparkSession
    path = path_for(spark, label)
    df.write.parquet(path)
    p, fs = _filesystem(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._folioflow_path = path
    return out


def drop_written(*frames: DataFrame) -> None:
    """Delete tables made by :func:`written` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_folioflow_path", None)
        if path:
            p, fs = _filesystem(df.sparkSession, path)
            fs.delete(p, True)


class Versions:
    """Tables under one folder that are only ever added to, version by version.

    A version is the parts that it adds to each table and a few facts; it
    exists once its commit file does, which is written last and never over
    another.  Who opens the folder again finds the newest version; a batch that
    fails leaves parts that no commit names.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def newest(self) -> int:
        """Number of the newest version; 0 where there is none."""
        p, fs = _filesystem(self.spark, self.path)
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(m.group(1)) for n in names if (m := re.fullmatch(r"commit-(\d+)", n))), default=0)

    def read(self, version: int | None = None) -> dict:
        """What a version holds: ``parts`` (table -> folders, its own and all earlier ones) and ``facts``."""
        version = self.newest() if version is None else version
        if not version:
            return {"version": 0, "parts": {}, "facts": {}}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/commit-{version}").collect()))

    def table(self, name: str, version: int | None = None) -> DataFrame | None:
        parts = self.read(version)["parts"].get(name)
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts]) if parts else None

    def add(self, parts: dict[str, DataFrame], facts: dict, after: int) -> int:
        """Commit version ``after`` + 1; an error if another writer has taken that number."""
        before = self.read(after)
        known = {name: list(p) for name, p in before["parts"].items()}
        for name, df in parts.items():
            part = f"{name}-{after + 1}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{part}")
            known.setdefault(name, []).append(part)
        text = json.dumps({"version": after + 1, "parts": known, "facts": facts})
        p, fs = _filesystem(self.spark, f"{self.path}/commit-{after + 1}")
        out = fs.create(p, False)  # not over another
        out.write(bytearray(text.encode()))
        out.close()
        return after + 1
