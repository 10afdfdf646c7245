from pyspark.sql import functions as F

from folioflow.functions.ids import file_id, hash_fraction, numbered_ids, stable_id
from folioflow.functions.names import numbered_name, plain_name, split_name


def test_names(spark):
    rows = ["X-0042", " x42\t", "l 00", "template07", "none", "N/A", "-", "", None, "abc", "  ", "Fatura_Doc-1a", "?!", "NaN", "x00000000000000000000007"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(numbered_name(F.col("t")).alias("n"), plain_name(F.col("t")).alias("p")).collect()
    assert [r.n for r in got] == ["x42", "x42", "l0", "template7", None, None, None, None, None, None, None, "faturadoca1", None, None, "x7"]
    assert [r.p for r in got] == ["x0042", "x42", "l00", "template07", None, None, None, None, None, "abc", None, "faturadoc1a", None, None, "x00000000000000000000007"]


def test_splits(spark):
    rows = ["TRAIN ", "training", "val", "dev", "Valid", "testing", "private-test", "Private Test", "unknown", "", None, "holdout"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(split_name(F.col("t"))).collect()
    assert [r[0] for r in got] == ["train", "train", "validation", "validation", "validation", "test", "private_test", "private_test", None, None, None, None]


def test_ids(spark):
    one = spark.createDataFrame([("ds", "./a\\b.png"), ("ds", "a/b.png")], "d string, p string")
    assert one.select(file_id(F.col("d"), F.col("p"))).distinct().count() == 1
    slashes = spark.createDataFrame([("ds", "a\\b.png"), ("ds", "a/b.png")], "d string, p string")
    assert slashes.select(stable_id("x", F.col("d"), F.col("p"))).distinct().count() == 1
    df = spark.createDataFrame([("coru", k) for k in ("c", "a", "b", "a", None)] + [(None, "q")] + [("big", f"k{i:04}") for i in range(500)], "d string, k string").repartition(5)
    got = {(r.d, r.k): r.document_id for r in numbered_ids(df, "d", "k").collect()}
    assert {k: v for k, v in got.items() if k[0] == "coru"} == {("coru", "a"): "coru_000000", ("coru", "b"): "coru_000001", ("coru", "c"): "coru_000002"}
    assert all(got[("big", f"k{i:04}")] == f"big_{i:06}" for i in range(500)) and len(got) == 503
    f = [r[0] for r in spark.range(200).select(hash_fraction(F.col("id"))).collect()]
    assert 0 <= min(f) < max(f) <= 1 and 0.4 < sum(f) / 200 < 0.6
