import json

import pytest
from pyspark.sql import functions as F

from folioflow.operators import validation as V
from folioflow.operators.learning import build_id, field_supervision, hybrid_tokens, matched_example, merged_regions, relation_supervision
from folioflow.sources import adapters as A, discovery as D, inventory as I, sinks as S
from folioflow.streaming import incremental as T


def tree(tmp_path):
    root = tmp_path / "data"
    files = {"form/train/img/a b.jpg": b"\xff\xd8x", "form/train/box/a b.txt": b"1,2", "form/train/ann/a.json": b'{"x": 1}', "form/train/ann/bad.json": b"{", "form/empty.txt": b"", "gmail/private.pdf": b"%PDF", "form/x.txt": b"\xe7ay"}
    for n, c in files.items():
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(c)
    return root


def test_inventory(spark, tmp_path):
    root = tree(tmp_path)
    rows = {r.original_relative_path: r for r in I.inventory(spark, str(root), "funsd").collect()}
    assert len(rows) == 7
    a = rows["form/train/img/a b.jpg"]
    assert a.is_image and a.is_readable and a.mime_type == "image/jpeg" and len(a.sha256) == 64 and a.file_id.startswith("funsd_") and len(a.file_id) == 18 and a.document_key == "a b"
    assert rows["form/train/ann/bad.json"].notes == "invalid_json" and not rows["form/train/ann/bad.json"].is_readable
    assert rows["form/train/ann/a.json"].notes == "" and rows["form/empty.txt"].is_empty and rows["form/empty.txt"].sha256 == ""
    assert rows["gmail/private.pdf"].is_private and rows["form/x.txt"].notes == "txt:non-utf8"
    inv = I.inventory(spark, str(root), "funsd")
    before = I.tree_digest(inv).first()
    (root / "form/x.txt").write_bytes(b"new")
    (root / "form/y.txt").write_bytes(b"y")
    old = spark.createDataFrame([(r.original_relative_path, r.sha256) for r in rows.values()], "original_relative_path string, sha256 string")
    now = I.inventory(spark, str(root), "funsd")
    assert {(r.original_relative_path, r.status) for r in I.compare_trees(old, now).collect()} == {("form/x.txt", "changed"), ("form/y.txt", "added")}
    assert before.files == 7 and I.tree_digest(now).first().digest != before.digest


def test_paths(spark):
    df = spark.createDataFrame([("a\\training_data\\x.png", "funsd"), ("fatura/Template10_Instance0.jpg", "fatura"), ("gmail/sub/n.PDF", "gmail"), ("x", "coru")], "p string, d string")
    p, d = F.col("p"), F.col("d")
    got = df.select(I.original_split(d, p), I.template_family(d, I.stem(p)), I.safe_path(p, F.lit("id")), I.component(d, p), I.extension(p)).collect()
    assert [tuple(x) for x in got] == [("train", "", "a\\training_data\\x.png", "training_data", ".png"), ("unspecified", "template10", "fatura/Template10_Instance0.jpg", "Template10_Instance0.jpg", ".jpg"), ("unspecified", "", "gmail/sub/id.pdf", "sub", ".pdf"), ("unspecified", "", "x", "coru", "")]
    groups = [("legal", ("fee", "contract")), ("invoice", ("invoice",)), ("receipt", ("receipt",))]
    names = spark.createDataFrame([("Fee_invoice.pdf",), ("invoice_receipt.pdf",), ("z.pdf",)], "n string")
    assert [x[0] for x in names.select(I.filename_category(F.col("n"), groups)).collect()] == ["legal", "invoice", "unclassified"]
    with pytest.raises(Exception, match="public tree"):
        spark.createDataFrame([("data/raw/public/gmail/x",)], "p string").select(I.not_private_in_public(F.col("p"))).collect()


def test_adapters(spark):
    text = "﻿0,0,10,0,10,5,0,5,Total, sum\n1,2,3\n0,0,x,0,10,5,0,5,t\n0,0,10,0,10,5,0,5,\n0,0,0,0,0,0,0,0,d\n"
    got = A.csv_lines(spark.createDataFrame([("p", text)], "page string, text string"), "page", "text").orderBy("line_no").collect()
    assert [(r.text, r.skipped) for r in got] == [("Total, sum", None), (None, "fewer_than_9_values"), (None, "invalid_coordinate"), (None, "empty_text"), (None, "degenerate_geometry")] and got[0].box == [0, 0, 10, 5]
    form = {"form": [{"id": 1, "label": "question", "text": "Name", "box": [0, 0, 5, 5], "words": [{"text": "Name", "box": [0, 0, 5, 5]}], "linking": [[1, 2], [1, 2], [1, 9]]}, {"id": 2, "label": "answer", "text": "Bob", "box": [6, 0, 9, 5], "words": [], "linking": [[1, 2]]}]}
    e = A.form_entities(spark.createDataFrame([("p", json.dumps(form))], "page string, c string"), "page", "c")
    assert [(r.source_id, r.label, r.text) for r in e.orderBy("source_id").collect()] == [(1, "QUESTION", "Name"), (2, "ANSWER", "Bob")]
    assert [(r.a, r.b, r.type) for r in A.form_relations(e, "page").collect()] == [(1, 2, "QUESTION_ANSWER")]
    grid = {"words": ["A", "B", " ", "C", "D"], "bboxes": [[0, 0, 5, 5], [6, 0, 300, 5], [0, 0, 5, 5], [0, 9, 5, 12], [0, 20, 5, 25]], "ner_tags": [1, 1, 1, 13, 10]}
    t = A.grid_tokens(spark.createDataFrame([("p", json.dumps(grid)), ("q", '{"words":["x"],"bboxes":[],"ner_tags":[]}')], "page string, c string"), "page", "c", F.lit(100), F.lit(100))
    assert [(r.text, r.label) for r in t.orderBy("token_no").collect()] == [("A", "VALUE"), ("B", "VALUE"), ("C", "OTHER"), ("D", "TABLE_CELL")]
    assert [(r.label, r.text) for r in A.grid_entities(t, "page").orderBy("run_no").collect()] == [("VALUE", "A B"), ("TABLE_CELL", "D")]
    qa = json.dumps([{"question": "What is the total?", "answer": "5"}, {"question": "Total again?", "answer": "6"}, {"question": "Due date?", "answer": "1.1."}, {"question": "", "answer": "x"}])
    q = A.question_fields(spark.createDataFrame([("p", qa)], "page string, c string"), "page", "c")
    assert {(r.field, r.value) for r in q.collect()} == {("total_amount", "5"), ("date", "1.1.")}
    n = A.named_fields(spark.createDataFrame([("p", json.dumps({"TOTAL": {"text": "9"}, "DATE": "1.1.", "OTHER": "x"}))], "page string, c string"), "page", "c", A.GRID_FIELDS)
    assert {(r.field, r.value) for r in n.collect()} == {("total_amount", "9"), ("date", "1.1.")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [1, 2]), (2, 0.5, None)], "a int, b double, c array<int>")
    S.write_csv(df, str(tmp_path / "csv"))
    assert {(r.a, r.b, r.c) for r in S.read_csv(spark, str(tmp_path / "csv")).collect()} == {("1", None, "[1,2]"), ("2", "0.5", None)}
    S.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    with pytest.raises(ValueError):
        S.write_csv(df, "data/raw/x")
    with pytest.raises(ValueError):
        S.require_below("/p/../x", "/p")
    rows = spark.createDataFrame([("aa1", 1, False), ("aa1", 1, False), ("bb2", 2, True), ("cc3", 3, None)], "digest string, v int, private boolean")
    assert S.cache_put(rows, str(tmp_path / "cache"), "digest", "private") == 1 and S.cache_put(rows, str(tmp_path / "cache"), "digest", "private") == 0
    assert S.cache_get(spark, str(tmp_path / "cache"), rows, "digest").count() == 1


def test_streams_are_idempotent(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("aa1", "Total: 5.00", False), ("bb2", "x", True)], "digest string, text string, private boolean").write.parquet(src)
    for _ in range(2):
        stream = T.file_stream(spark, src, spark.read.parquet(src).schema)
        T.cache_stream(stream, str(tmp_path / "cache"), "digest", "private", str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 1
    q = T.run_requests(T.file_stream(spark, src, spark.read.parquet(src).schema), lambda d: d.select("digest", F.length("text").alias("n")), str(tmp_path / "out"), str(tmp_path / "ck2"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_discovery_and_settings(spark):
    assert D.settings({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}, "b": 1}
    assert D.name_filter(" A, b,,") == ["a", "b"] and D.name_filter(None) is None and D.name_filter("") is None
    paths = spark.createDataFrame([("r1/SROIE2019/x.txt",), ("r2/forms/a.png",), ("r2/forms/b.png",)], "p string")
    sig = {"sroie": {"markers": ["sroie2019"], "names": ["receipts"], "suffixes": [".txt"]}, "funsd": {"markers": ["training_data"], "names": ["r2"], "suffixes": [".png"]}}
    got = {(r.root, r.dataset): (r.confidence, r.files) for r in D.discover(paths, "p", F.substring_index("p", "/", 1), sig).collect()}
    assert got[("r1", "sroie")] == ("high", 1) and got[("r2", "funsd")] == ("medium", 2) and got[("r1", "funsd")][0] == "low"
    one, two = spark.createDataFrame([("a",), ("b",)], "s string"), spark.createDataFrame([("b",)], "s string")
    assert {tuple(r) for r in D.native_splits({"train": one, "test": two}, "s").collect()} == {("a", "train"), ("b", "test")}
    m, e = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, v string"), spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    assert {tuple(r) for r in D.drifted(m, e, "id", ["v"]).collect()} == {(2, "v"), (3, "(missing)")}
    b = spark.createDataFrame([(bytearray("﻿çay".encode()),), (bytearray(b"\xe7ay"),), (None,)], "c binary")
    assert [r[0] for r in b.select(D.decode_source(F.col("c"))).collect()] == ["çay", "çay", None]


def test_supervision_and_examples(spark):
    tok = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "c", False), (1, "d", True)], "p int, t string, masked_in boolean")
    ev = spark.createDataFrame([(1, "a", "date"), (1, "b", "date"), (1, "b", "tax"), (1, "c", "tax"), (1, "d", "odd")], "p int, t string, field string")
    assert {r.t: r.label_id for r in field_supervision(tok, ev, "p", "t", {"date": 1, "tax": 2}).collect()} == {"a": 1, "b": -100, "c": -100, "d": 0}
    pairs = spark.createDataFrame([(1, "k", v, "KEY", lab, dist) for v, lab, dist in (("v1", "VALUE", 1.0), ("v2", "VALUE", 2.0), ("v3", "KEY", 0.5), ("v4", "VALUE", 9.0))], "p int, source_id string, target_id string, source_label string, target_label string, distance double")
    pos = spark.createDataFrame([(1, "k", "v1", "KEY_VALUE")], "p int, source_id string, target_id string, type string")
    assert {(r.target_id, r.type) for r in relation_supervision(pairs, pos, "p", 2).collect()} == {("v1", "KEY_VALUE"), ("v2", "NO_RELATION"), ("v4", "NO_RELATION")}
    ref = spark.createDataFrame([(1, 1, "Inv"), (1, 2, "No"), (1, 3, "lost")], "p int, id int, text string")
    ocr = spark.createDataFrame([(1, 7, "InvNo"), (1, 8, "extra")], "p int, id int, text string")
    m = spark.createDataFrame([(1, 1, 7, "KEY"), (1, 2, 7, "KEY")], "p int, ref_id int, other_id int, label string")
    assert {(r.ref_id, r.text, r.origin) for r in hybrid_tokens(ref, ocr, m, "p").collect()} == {(1, "InvNo", "ocr"), (2, "No", "source"), (3, "lost", "source"), (None, "extra", "extra")}
    assert {r.id: r.label for r in matched_example(ocr, m, "p").collect()} == {7: "KEY", 8: "OTHER"}
    reg = spark.createDataFrame([(1, 1, "a", 0.0, 1.0, False), (1, 2, "b", 0.0000001, 1.0, True)], "p int, id int, text string, x double, y double, ignored boolean")
    r = merged_regions(reg, "p", ["x", "y"]).first()
    assert (r.text, r.ignored, r.tokens) == ("a b", False, 2)
    assert build_id(ref, ["p", "id"], "x").first() == build_id(ref.orderBy(F.desc("id")), ["p", "id"], "x").first()
    assert V.foreign_keys(m, ["ref_id"], ref.where("id = 1"), ["id"]).count() == 1
