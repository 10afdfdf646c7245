import json

import pytest
from folioflow.operators import metrics as M, records as R
from folioflow.storage import Versions
from pyspark.sql import functions as F


def test_canonical_json_is_that_of_the_language(spark):
    rows = [("a ü/\"\\ ไ😀\n\x01", 1, True), (None, None, None), ("", -5, False)]
    df = spark.createDataFrame(rows, "s string, n long, b boolean")
    got = [r[0] for r in df.select(R.canonical_json({"z": F.col("s"), "a": F.col("n"), "m": F.col("b")})).collect()]
    assert got == [json.dumps({"z": s, "a": n, "m": b}, sort_keys=True, separators=(",", ":")) for s, n, b in rows]


def test_a_field_that_is_not_canonical_is_an_error(spark):
    best = spark.createDataFrame([(1, "date", "x", 0.5), (1, "colour", "red", 0.5)], "doc_id int, field string, value string, confidence double")
    with pytest.raises(Exception, match="unsupported canonical field"):
        R.document_results(best, "doc_id").collect()
    one = R.document_results(best.where("field = 'date'").withColumn("confidence", F.lit(1.5)), "doc_id").first()
    assert one.broken == "confidence" and json.loads(one.fields)["date"] == "x" and len(json.loads(one.fields)) == 27
    assert R.document_results(best.limit(0), "doc_id").count() == 0


def test_gates_refuse_private_rows_and_failed_checks(spark):
    base = dict(wer=0.5, critical_exact=0.3, numeric_exact=0.5, amount_exact=0.5, english_exact=0.5, turkish_accuracy=0.9, seconds=0.1, confidence_finite=True, export_reload_passed=True, dictionary_match_passed=True, private_rows=0)
    rows = [("base", *base.values()), ("good", *{**base, "wer": 0.4, "critical_exact": 0.4}.values()), ("private", *{**base, "wer": 0.4, "critical_exact": 0.4, "private_rows": 1}.values()), ("unloaded", *{**base, "wer": 0.4, "critical_exact": 0.4, "export_reload_passed": None}.values())]
    t = spark.createDataFrame(rows, "name string, wer double, critical_exact double, numeric_exact double, amount_exact double, english_exact double, turkish_accuracy double, seconds double, confidence_finite boolean, export_reload_passed boolean, dictionary_match_passed boolean, private_rows int")
    g = M.recognizer_gate("b", "c", 1.0)
    got = t.alias("c").crossJoin(t.where("name = 'base'").alias("b")).select(F.col("c.name").alias("n"), M.accepted(g).alias("ok"))
    assert len(g) == 10 and {r.n: r.ok for r in got.collect()} == {"base": False, "good": True, "private": False, "unloaded": False}
    assert len(M.detector_gate("b", "c", 1.0)) == 9


def test_ten_clusters_are_mapped(spark):
    cells = [(p, (p + 3) % 10, 50) for p in range(10)] + [(p, p, 49) for p in range(10)]
    t = spark.createDataFrame(cells, "predicted int, truth int, n long")
    assert {(r.predicted, r.truth) for r in M.best_mapping(t, 10).collect()} == {(p, (p + 3) % 10) for p in range(10)}
    even = spark.createDataFrame([(p, t, 1) for p in range(3) for t in range(3)], "predicted int, truth int, n long")
    assert [(r.predicted, r.truth) for r in M.best_mapping(even, 3).orderBy("predicted").collect()] == [(0, 0), (1, 1), (2, 2)]


def test_versions_are_found_again_and_never_overwritten(spark, tmp_path):
    path = "file://" + str(tmp_path / "v")
    v = Versions(spark, path)
    assert v.newest() == 0 and v.table("t") is None
    v.add({"t": spark.range(3)}, {"n": 3}, 0)
    Versions(spark, path).add({"t": spark.range(3, 5)}, {"n": 5}, 1)
    again = Versions(spark, path)
    assert again.newest() == 2 and again.read()["facts"] == {"n": 5} and sorted(r.id for r in again.table("t").collect()) == [0, 1, 2, 3, 4] and again.table("t", 1).count() == 3
    with pytest.raises(Exception):
        v.add({"t": spark.range(9)}, {}, 1)
    assert again.table("t").count() == 5
