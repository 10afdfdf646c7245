import os

from pyspark.sql import functions as F

from folioflow.sources.tables import current_rows
from folioflow.storage import drop_written, shared_dir, written


def test_tables_are_written_where_the_session_says(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = written(spark.range(5).withColumn("x", F.lit(None).cast("string")), "t")
    path = df._folioflow_path
    assert path.startswith(shared_dir(spark)) and df.count() == 5 and df.dtypes == [("id", "bigint"), ("x", "string")]
    drop_written(df)
    assert not os.path.exists(path.removeprefix("file://"))


def test_current_rows(spark):
    rows = [("a", 2, 1, "new"), ("a", 1, 9, "late"), ("a", 2, 1, "new"), ("b", 1, 1, None), (None, 9, 9, "x"), ("c", 3, 1, "p"), ("c", 3, 2, "q")]
    df = spark.createDataFrame(rows, "k string, recorded_at int, ingested_at int, v string")
    assert {(r.k, r.v) for r in current_rows(df, "k", ["v"]).collect()} == {("a", "new"), ("b", None), ("c", "q")}
    assert current_rows(df.limit(0), "k", ["v"]).count() == 0
