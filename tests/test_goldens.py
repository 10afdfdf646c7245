"""Known cases of the operators: input rows and the results they have to give."""

import math

import pytest
from pyspark.sql import functions as F

from folioflow.functions import geometry as G, noise as N, text as X
from folioflow.operators import clusters as C, extract as E, learning as L, matching as M, metrics as K, recognition as R, sampling, validation as V
from folioflow.operators.audit import duplicate_report, exact_duplicates, leakage, longest_prefix, unpaired, deal_components


def lines(spark, texts, confidence=0.9):
    rows = [(1, 1, i, t, 0.0, 20.0 * i, 8.0 * len(t or ""), 20.0 * i + 16, confidence) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id int, page_number int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")


def best(spark, texts):
    ls = lines(spark, texts)
    c = E.rule_candidates(ls).select("doc_id", "line_no", "field", "value", "raw_text", "field_confidence").unionByName(E.header_organization(ls, ["doc_id"]))
    return E.best_fields(c, ["doc_id"])


def test_multilingual_rules(spark):
    texts = ["ACME COMPANY", "Fatura No: INV-2026-7", "Ara Toplam: 100,00 TL", "KDV: 7,00 TL", "Genel Toplam: 107,00 TL", "mail: info@acme.com", "Nakit", None, "   "]
    b = best(spark, texts)
    got = {r.field: r.value for r in b.collect()}
    assert got["invoice_number"] == "INV-2026-7" and got["subtotal"] == "100.00" and got["tax"] == "7.00" and got["total_amount"] == "107.00"
    assert got["currency"] == "TRY" and got["email"] == "info@acme.com" and got["payment_method"] == "cash" and got["organization_name"] == "ACME COMPANY"
    t = E.total_consistency(b, ["doc_id"]).first()
    assert t.total_status == "validated" and t.balance_status == "not_checked"


def test_further_rules_and_no_website_in_an_address(spark):
    texts = ["Vendor: Shop One", "Customer: Bob", "www.shop.com.", "Time 14:35", "Tax ID: TH-123456789", "Discount: 5.00", "Service charge: 10.00", "Paid: 105.00", "Balance due: 0.00"]
    got = {r.field: r.value for r in best(spark, texts).collect()}
    assert (got["vendor_name"], got["customer_name"], got["website"], got["time"]) == ("Shop One", "Bob", "www.shop.com", "14:35")
    assert (got["tax_identification_number"], got["discount"], got["service_charge"], got["paid_amount"], got["balance"]) == ("TH-123456789", "5.00", "10.00", "105.00", "0.00")
    got = {r.field for r in best(spark, ["Website: www.name@gmail.com"]).collect()}
    assert "website" not in got and "email" in got


def test_equal_confidence_takes_the_earliest_line_and_tells_the_conflict(spark):
    r = {x.field: x for x in best(spark, ["Total: 10.00", "Total: 20.00"]).collect()}["total_amount"]
    assert (r.value, r.line_no, r.conflict) == ("10.00", 0, True)
    assert best(spark, []).count() == 0


@pytest.mark.parametrize("raw,rule,loose", [("1,234", "1.23", 1234), ("1.234,56", "1234.56", 1234.56), ("1,234.56", "1234.56", 1234.56), ("12,5", "125.00", 12.5), ("1,234,567", "1234567.00", 1234567), ("1.234.567", None, 1234.567), ("0.125", "0.12", 0.125), ("THB 99.995", "100.00", 99.995), ("x", None, None)])
def test_money(spark, raw, rule, loose):
    r = spark.createDataFrame([(raw,)], "t string").select(X.money(F.col("t")).cast("string").alias("m"), X.loose_decimal(F.col("t")).cast("double").alias("d")).first()
    assert (r.m, r.d) == (rule, loose)


@pytest.mark.parametrize("raw,rule", [("12345678901234567890", "12345678901234567890.00"), ("-1,234,567,890,123,456,789.5", "-1234567890123456789.50"), ("9" * 34, "9" * 34 + ".00"), ("9" * 35, None), ("0.1250000000001", "0.13"), ("0.13499999999999", "0.13"), ("0.1250000000000", "0.12")])
def test_long_amounts(spark, raw, rule):
    assert spark.createDataFrame([(raw,)], "t string").select(X.money(F.col("t")).cast("string")).first()[0] == rule


def test_a_long_amount_is_evidence_like_any_other(spark):
    r = E.rule_candidates(lines(spark, ["Total: 12345678901234567890", "Tax: 1.00"])).where("field IN ('total_amount', 'tax')").orderBy("line_no").collect()
    assert [(x.field, x.value) for x in r] == [("total_amount", "12345678901234567890.00"), ("tax", "1.00")]


def test_amounts_of_documents_of_any_length(spark, tmp_path):
    from folioflow.plans.extraction import money_normalize

    spark.createDataFrame([(1, "Ref 12345678901234567890\nSum 1234567890123456789012345.50 EUR\nSum 1.234,56")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.raw, r.rule_amount, r.loose_amount, r.mark) for r in money_normalize(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [("12345678901234567890", 12345678901234567890.0, 12345678901234567890.0, None), ("1234567890123456789012345.50 EUR", 1234567890123456789012345.5, 1234567890123456789012345.5, "."), ("1.234,56", 1234.56, 1234.56, ",")]


@pytest.mark.parametrize("raw,iso", [("31.12.2024", "2024-12-31"), ("2024/2/31", "2024-02-31"), ("1-2-24", ""), ("2024-13-01", ""), ("no date", ""), ("12 2024", "")])
def test_dates(spark, raw, iso):
    assert spark.createDataFrame([(raw,)], "t string").select(X.iso_date(F.col("t"))).first()[0] == iso


def test_unicode_kernels(spark):
    df = spark.createDataFrame([("ﬁne  İX", "fine i̇x"), (None, "a"), ("", "a")], "a string, b string")
    got = df.select(X.norm_text("a"), X.similarity("a", "b"), X.word_distance("a", "b")).collect()
    assert got[0][0] == "fine i̇x" and got[0][1] == 1.0 and got[1][0] is None and got[1][2] is None and got[2][1] == 0.0 and got[2][2] == 1
    assert spark.range(1).select(F.levenshtein(F.lit("kitten"), F.lit("sitting"))).first()[0] == 3
    g = spark.createDataFrame([("aaaaab",), ("ab",), ("...",), ("",)], "t string").select(X.garbage(F.col("t"))).collect()
    assert [x[0] for x in g] == [True, False, True, True]


def test_key_values_and_nearest_relation(spark):
    kv = E.key_values(lines(spark, ["Date: 1.1.2024", "no colon", ": empty key", "empty value:"]))
    assert [(r.label, r.entity_text) for r in kv.orderBy("ex0").collect()] == [("KEY", "Date"), ("VALUE", "1.1.2024")]
    assert all(abs(r.entity_confidence - 0.72) < 1e-9 for r in kv.collect())
    ents = [(1, 1, "k", "KEY", 10.0, 10.0, 60.0, 30.0), (1, 1, "near", "VALUE", 70.0, 10.0, 120.0, 30.0), (1, 1, "far", "VALUE", 900.0, 900.0, 950.0, 930.0), (1, 2, "other", "VALUE", 70.0, 10.0, 120.0, 30.0)]
    e = spark.createDataFrame(ents, "doc_id int, page_number int, entity_id string, label string, ex0 double, ey0 double, ex1 double, ey1 double")
    r = E.best_relations(E.relation_candidates(e, 0.5)).collect()
    assert [(x.source_id, x.target_id, x.relation_type) for x in r] == [("k", "near", "KEY_VALUE")] and r[0].confidence > 0.8


def test_runs_and_tags(spark):
    rows = [(1, i, lab, ent) for i, (lab, ent) in enumerate([("KEY", "a"), ("KEY", "a"), ("VALUE", "b"), ("OTHER", None), ("ANSWER", None), ("ANSWER", None)])]
    df = spark.createDataFrame(rows, "d int, i int, label string, ent string")
    assert [r.tag[0] for r in E.bio_tags(df, ["d"], "i", "label", "ent").orderBy("i").collect()] == list("BIBOBI")
    assert [(r.run_value, r.run_length) for r in E.runs(df, ["d"], "i", "label").orderBy("run_no").collect()] == [("KEY", 2), ("VALUE", 1), ("OTHER", 1), ("ANSWER", 2)]


def test_spans_of_tags(spark):
    rows = [(1, i, t, w, float(i), 0.0, i + 1.0, 1.0, 0.5) for i, (t, w) in enumerate([("B-KEY", "Invoice"), ("I-KEY", "Number"), ("B-VALUE", "123"), ("O", "x"), ("I-VALUE", "9")])]
    df = spark.createDataFrame(rows, "d int, i int, tag string, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    assert [(r.label, r.text) for r in L.token_spans(df, ["d"], "i", "tag").orderBy("first_at").collect()] == [("KEY", "Invoice Number"), ("VALUE", "123"), ("VALUE", "9")]


def test_fusion_abstains_in_a_near_tie(spark):
    v = spark.createDataFrame([(1, "10.00", 0.80), (1, "20.00", 0.82), (2, "A  b", 0.5), (2, "a B", 0.6), (2, "c", 0.4)], "d int, value string, confidence double")
    got = {r.d: r for r in E.fuse_document(v, ["d"]).collect()}
    assert got[1].value is None and got[1].abstained
    assert got[2].value == "a B" and got[2].n == 2 and abs(got[2].score - 0.63) < 1e-9
    t = spark.createDataFrame([(1, "invoice", 0.9), (1, "receipt", 0.85), (2, "invoice", 0.9), (2, "receipt", 0.2)], "d int, t string, c double")
    assert {r.d: r.document_type for r in E.fuse_types(t, ["d"], "t", "c").collect()} == {1: "unknown", 2: "invoice"}


def test_decoding_with_thresholds(spark):
    labels = ["NONE", "total_amount", "currency"]
    rows = [(1, 0, "107", [0.05, 0.9, 0.05]), (1, 1, "TRY", [0.1, 0.05, 0.85])]
    df = spark.createDataFrame(rows, "d int, i int, text string, v array<double>")
    got = L.decode_fields(df, ["d"], "i", "v", labels, {"total_amount": 0.8, "currency": 0.9}, 0.5).collect()
    assert [(r.field, r.value) for r in got] == [("total_amount", "107")]
    types = ["invoice", "receipt", "form", "other"]
    t = spark.createDataFrame([([0.1, 0.7, 0.1, 0.1],), ([0.3, 0.3, 0.2, 0.2],)], "v array<double>").select(L.decode_type(F.col("v"), types, 0.6)).collect()
    assert [x[0] for x in t] == ["receipt", "unknown"]


def test_windows_average_and_cover(spark):
    p = spark.createDataFrame([(1, 0, [0.2, 0.8]), (1, 1, [0.3, 0.7]), (1, 1, [0.5, 0.5]), (1, 2, [0.1, 0.9])], "d int, w int, v array<double>")
    got = {r.w: [round(x, 9) for x in r.mean_vector] for r in C.window_average(p, ["d"], "w", "v").collect()}
    assert got == {0: [0.2, 0.8], 1: [0.4, 0.6], 2: [0.1, 0.9]}
    s = spark.createDataFrame([(1, list(range(100))), (2, [1]), (3, [])], "k int, v array<int>")
    w = L.windows(s, "k", "v", 40, 10).collect()
    assert {x for r in w if r.k == 1 for x in r["items"]} == set(range(100)) and {r.k for r in w} == {1, 2}


def test_boxes_match_one_to_one(spark):
    box = "p int, id int, x0 double, y0 double, x1 double, y1 double"
    ref = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 100.0, 100.0, 110.0, 300.0)], box)
    pred = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 1.0, 0.0, 10.0, 10.0), (1, 3, 100.0, 100.0, 110.0, 290.0), (2, 9, 0.0, 0.0, 10.0, 10.0)], box)
    m = M.match_boxes(ref, pred, "p")
    assert {(r.ref_id, r.pred_id) for r in m.collect()} == {(1, 1), (2, 3)}
    pages = R.detector_pages(ref.withColumn("critical", F.col("id") == 1), pred.where("p = 1"), m, "p", 1000.0)
    c = R.detector_corpus(pages, []).first()
    assert (c.true_positive, round(c.precision, 4), c.recall, round(c.f1, 4), c.critical_recall, c.small_recall, c.medium_recall) == (2, 0.6667, 1.0, 0.8, 1.0, 1.0, 1.0)


def test_suppression_order_and_grid(spark):
    schema = "p int, id int, text string, x0 double, y0 double, x1 double, y1 double, confidence double"
    w = spark.createDataFrame([(1, 1, "Total", 0.0, 0.0, 50.0, 10.0, 0.9), (1, 2, "total", 2.0, 0.0, 50.0, 10.0, 0.8), (1, 3, "else", 0.0, 0.0, 30.0, 10.0, 0.7), (1, 4, "", 0.0, 0.0, 9.0, 9.0, 0.9), (1, 5, None, 80.0, 0.0, 90.0, 9.0, None)], schema)
    assert {r.id for r in M.suppress(w, "p").collect()} == {1, 3}
    o = spark.createDataFrame([(1, 1, "b", 50.0, 2.0, 60.0, 12.0, 1.0), (1, 2, "a", 0.0, 0.0, 10.0, 10.0, 1.0), (1, 3, "c", 0.0, 30.0, 10.0, 40.0, 1.0)], schema)
    assert [r.text for r in M.reading_order(o, "p").orderBy("position").collect()] == ["a", "b", "c"]
    assert [r.text for r in M.line_groups(o, "p").orderBy("line_no").collect()] == ["a b", "c"]
    cells = [(1, 10 * r + c, t, 100.0 * c, 30.0 * r, 100.0 * c + 50, 30.0 * r + 10, 1.0) for r, row in enumerate([["Item", "Qty", "Amount"], ["pen", "2", "4.00"], ["cup", "1", "9.00"]]) for c, t in enumerate(row)]
    g = M.table_grid(spark.createDataFrame(cells + [(2, 1, "alone", 0.0, 0.0, 1.0, 1.0, 1.0)], schema), "p").orderBy("row_index", "column_index").collect()
    assert [r.semantic for r in g[:3]] == ["description", "quantity", "line_total"] and [r.row_type for r in g] == ["header"] * 3 + ["item"] * 6


def test_alignment_equals_all_pairs(spark):
    import random

    r = random.Random(3)
    words = ["İSTANBUL", "istanbul", "Invoice", "lnvoice", "No", "No:", "12.50", "12,50", "Grand Total", "Total", "..", "ไทย"]
    schema = "p int, id int, text string, x0 double, y0 double, x1 double, y1 double"

    def made(n):
        return [(p, i, r.choice(words), x := r.uniform(0, 80), y := r.uniform(0, 80), x + 20, y + 8) for p in (1, 2, 3) for i in range(n)]

    a, b = made(14), made(12) + [(4, 1, "No", 0.0, 0.0, 1.0, 1.0)]
    got = sorted((x.p, x.ref_id, x.other_id, round(x.score, 9), x.kind) for x in M.align(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "p").collect())
    want = []
    for p in (1, 2, 3):
        import numpy as np

        ra, rb = [x for x in a if x[0] == p], [x for x in b if x[0] == p]
        found = []
        for i, x in enumerate(ra):
            for j, y in enumerate(rb):
                u, v = M.plain(x[2]), M.plain(y[2])
                if u and v:
                    s, kind = M.text_score(u, v)
                    s = 0.7 * s + 0.3 * M.place_scores(np.array([x[3:]]), np.array([y[3:]]))[0, 0]
                    if s >= 0.45:
                        found.append((s, i, j, kind))
        ua, ub = set(), set()
        for s, i, j, kind in sorted(found, reverse=True):
            if "contains" in kind or (i not in ua and j not in ub):
                ua.add(i)
                ub.add(j)
                want.append((p, ra[i][1], rb[j][1], round(s, 9), kind))
    assert got == sorted(want) and M.plain("İSTANBUL") == M.plain("istanbul")


def test_alignment_of_a_long_page_read_twice(spark):
    """6,000 words of 3,000 texts, and the same a little off: no pair of unlike texts can come before a word and itself."""
    import random
    import time

    r = random.Random(5)
    voc = ["".join(r.choice("aeinrst") for _ in range(8)) for _ in range(3000)]
    schema = "p int, id int, text string, x0 double, y0 double, x1 double, y1 double"
    page = [(1, i, voc[i % 3000], x := 100.0 * (i % 10), y := 20.0 * (i // 10), x + 60, y + 16) for i in range(6000)]
    shifted = [(p, i, t, *(e + i % 5 for e in box)) for p, i, t, *box in page]
    a, b = spark.createDataFrame(page, schema), spark.createDataFrame(shifted, schema)
    began = time.monotonic()
    got = M.align(a, b, "p").collect()
    assert time.monotonic() - began < 20
    assert sorted((x.ref_id, x.other_id) for x in got if x.kind == "exact") == [(i, i) for i in range(6000)]
    assert {x.kind for x in got} == {"exact"}


def test_counts_of_alignments_are_those_of_their_pairs(spark, sf):
    from folioflow.plans import layout

    words = layout._words(spark, sf)
    pairs = M.align(words, layout._shifted(words), "doc_id").groupBy("doc_id", "kind").count()
    counts = layout.align_tokens(spark, sf)
    assert counts.columns == ["doc_id", "kind", "n"] and sorted(map(tuple, counts.collect())) == sorted(map(tuple, pairs.collect()))


def test_alignment_of_null_ids_pages_and_texts(spark):
    schema = "p int, id int, text string, x0 double, y0 double, x1 double, y1 double"
    a = spark.createDataFrame([(None, 1, "No", 0.0, 0.0, 9.0, 9.0), (1, None, "No", 0.0, 0.0, 9.0, 9.0), (1, 2, None, 0.0, 0.0, 9.0, 9.0)], schema)
    b = spark.createDataFrame([(None, 7, "No", 0.0, 0.0, 9.0, 9.0), (1, 8, "no.", 0.0, 0.0, 9.0, 9.0), (2, 9, "No", 0.0, 0.0, 9.0, 9.0)], schema)
    got = {(x.p, x.ref_id, x.other_id, x.score, x.kind) for x in M.align(a, b, "p").collect()}
    assert got == {(None, 1, 7, 1.0, "exact"), (1, None, 8, 1.0, "exact")}
    assert M.align(a.limit(0), b, "p").count() == 0 and M.align(a, b.limit(0), "p").count() == 0


def test_calibration_and_thresholds(spark):
    df = spark.createDataFrame([(0.95, 1), (0.8, 1), (0.2, 0), (0.1, 0)], "c double, ok int")
    assert abs(K.ece(df, "c", "ok", 4).first().ece - 0.1375) < 1e-12
    p = spark.createDataFrame([(0.9, 1, 1), (0.8, 1, 1), (0.4, 1, 0), (0.9, 0, 0)], "c double, p int, l int")
    b = K.best_positive_threshold(p, "c", "p", "l").first()
    assert (b.threshold, b.f1) == (0.8, 1.0)
    d = spark.createDataFrame([(0.95, True)] * 9 + [(0.30, False)], "c double, ok boolean")
    assert 0.30 < K.best_coverage_threshold(d, "c", "ok", 0.9).first().threshold <= 0.95
    assert K.best_positive_threshold(p.limit(0), "c", "p", "l").first().threshold == 0.5
    assert K.best_positive_threshold(p.where("l = 0"), "c", "p", "l").first().threshold == 1.0
    a = p.select(K.abstain(F.col("c"), F.col("p"), F.when(F.col("p") == 1, 0.75).otherwise(0.9))).collect()
    assert [x[0] for x in a] == [1, 1, 0, 0]


def test_temperature(spark):
    rows = [([4.0, 0.0], 0)] * 70 + [([4.0, 0.0], 1)] * 30
    t = K.fit_temperature(spark.createDataFrame(rows, "z array<double>, y int"), "z", "y")
    assert abs(t - 4 / math.log(7 / 3)) < 1.0 or t == pytest.approx(4.0, abs=0.01)


def test_angles(spark):
    a = spark.createDataFrame([(float(x),) for x in (0, 360, 720, -360, -1, 361.5, -450)], "a double").select(K.normalize_angle(F.col("a"))).collect()
    assert [x[0] for x in a] == [0, 0, 0, 0, 359, 1.5, 270]
    z = spark.createDataFrame([(float(x),) for x in (0, 89.999, 90, 180, 270, 359.9, -1)], "a double").select(K.rotation_zone(F.col("a"))).collect()
    assert [x[0] for x in z] == [1, 1, 2, 3, 4, 4, 4]
    assert spark.range(1).select(K.circular_error(F.lit(359.0), F.lit(1.0))).first()[0] == 2


def test_critical_fields(spark):
    rows = [("date", "31.12.2024", "2024-12-31"), ("invoice_number", "INV 7", "inv-7"), ("currency", "฿", "THB"), ("email", "A@b.c", " a@B.c"), ("phone", "+1 23", "123"), ("total_amount", "10.00", "10.01"), ("organization", "Acme Ltd", "Acme Ltd"), ("address", "1 High St", None), ("generic", "x", "X"), ("date", " ", "z")]
    s = R.field_metrics(spark.createDataFrame(rows, "f string, r string, p string"), "f", "r", "p", 0.02)
    got = {x.f: x for x in s.collect()}
    assert all(got[f].exact for f in ("date", "invoice_number", "currency", "email", "phone", "organization", "generic"))
    assert not got["total_amount"].exact and got["total_amount"].within_tolerance and not got["address"].exact and got["address"].token_recall == 0.0
    assert R.field_summary(s, []).first().evaluated == 9


def test_recognition_slices(spark):
    rows = [("Total 10.00", "Total 10.00", "amount", 0.9), ("31.12.2024", "31.12.2O24", "date", 0.4), ("çay", "cay", "", 0.5)]
    s = R.samples(spark.createDataFrame(rows, "r string, p string, k string, c double"), "r", "p", "k")
    c = R.corpus(s, [], "c").first()
    assert (round(c.exact, 4), c.numeric_exact, c.amount_exact, c.date_exact, c.email_exact, c.turkish_accuracy) == (0.3333, 0.5, 1.0, 0.0, None, 0.0)


def test_clusters(spark):
    t = spark.createDataFrame([(0, 0, 5), (1, 1, 5)], "truth int, predicted int, n long")
    c = K.clustering_scores(t).first()
    assert (c.purity, c.adjusted_rand, round(c.v_measure, 9)) == (1.0, 1.0, 1.0)
    d = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (2, 0, 1.0), (2, 1, 4.0)], "k int, c int, distance double")
    got = {r.k: (r.c, r.confidence) for r in C.nearest(d, "k", "c").collect()}
    assert got == {1: (0, 0.0), 2: (0, 0.75)}


def test_geometry(spark):
    sq = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]
    turned = [[1.0, -0.5], [2.5, 1.0], [1.0, 2.5], [-0.5, 1.0]]
    assert G.convex_iou(sq, sq) == 1.0 and G.convex_iou(sq, None) == 0.0 and G.convex_iou(sq, [[5, 5], [6, 5], [6, 6]]) == 0.0
    assert abs(G.convex_intersection(sq, turned) - (4 - 4 * 0.5 * 0.5 * 0.5)) < 1e-9
    df = spark.createDataFrame([(sq, [[0.0, 0.0], [2.0, 2.0], [2.0, 0.0], [0.0, 2.0]])], "a array<array<double>>, b array<array<double>>")
    r = df.select(G.area(F.col("a")), G.crosses_itself("a"), G.crosses_itself("b"), G.polygon_iou("a", "a")).first()
    assert tuple(r) == (4.0, False, True, 1.0)
    t = spark.range(1).select(G.rotation(F.lit(100), F.lit(50), F.lit(90.0)).alias("t")).first().t
    assert (t.width, t.height) == (50, 100)
    b = spark.range(1).select(G.to_thousand(F.array(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(200.0)), F.lit(100.0), F.lit(200.0))).first()[0]
    assert b == [0, 0, 1000, 1000]
    with pytest.raises(Exception, match="outside"):
        spark.range(1).select(G.to_thousand(F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(2.0)), F.lit(100.0), F.lit(200.0))).collect()


def test_audits(spark):
    rows = spark.createDataFrame([("a", "d1", "x"), ("b", "d2", "x"), ("c", "d1", "y"), ("e", "d1", ""), ("f", "d1", None), ("g", "d1", None)], "k string, ds string, sha string")
    assert [(r.sha, r.n) for r in exact_duplicates(rows, "sha").collect()] == [("x", 2)]
    rep = duplicate_report(rows, "sha", "ds", "k").orderBy("k").collect()
    assert [(r.k, r.canonical, r.crosses, r.is_canonical) for r in rep] == [("a", "a", True, True), ("b", "a", True, False)]
    assert {(r.k, r.missing) for r in unpaired(rows.where("k < 'c'").select("k"), rows.where("k > 'a' AND k < 'd'").select("k"), ["k"], ("left", "right")).collect()} == {("a", "right"), ("c", "left")}
    p = longest_prefix(spark.createDataFrame([("A_1_coco",), ("B",)], "s string"), "s", spark.createDataFrame([("A",), ("A_1",)], "t string"), "t")
    assert {r.s: r.matched for r in p.collect()} == {"A_1_coco": "A_1", "B": None}
    bad = leakage(rows.withColumn("split", F.when(F.col("k") == "a", "train").otherwise("test")), "split", {"sha": F.col("sha")})
    assert [(r.identity, r.splits) for r in bad.collect()] == [("x", 2)]


def test_samples(spark):
    q = sampling.apportion(spark.createDataFrame([("a", 50), ("b", 30), ("c", 20)], "k string, n long"), "k", "n", 7)
    assert {r.k: r.quota for r in q.collect()} == {"a": 4, "b": 2, "c": 1} or sum(r.quota for r in q.collect()) == 7
    rows = spark.createDataFrame([(i, "big" if i < 90 else f"s{i % 3}") for i in range(100)], "id int, s string")
    one = sampling.round_robin(rows, ["s"], "id", 12)
    assert {r.s: r.n for r in one.groupBy("s").agg(F.count("*").alias("n")).collect()} == {"big": 3, "s0": 3, "s1": 3, "s2": 3}
    again = sampling.round_robin(rows.repartition(9), ["s"], "id", 12)
    assert {r.id for r in one.collect()} == {r.id for r in again.collect()}
    d = deal_components(spark.createDataFrame([(f"c{i}", 1 + i % 3) for i in range(3000)] + [("huge", 1500)], "c string, n long"), "c", "n", {"train": 0.7, "dev": 0.3})
    share = {r.split: r.n for r in d.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    assert abs(share["train"] / 7500 - 0.7) < 0.01


def test_noise(spark):
    df = spark.createDataFrame([("O0l",), ("12.50",), ("a-b",), ("-",), ("abcdef",), ("ab cd",), ("zz",), (None,)], "t string")
    got = df.select(N.confuse(F.col("t")), N.drop_mark(F.col("t")), N.respace(F.col("t")), N.swap_decimal(F.col("t"))).collect()
    assert [x[0] for x in got][:2] == ["OOl", "12.5O"] and [x[1] for x in got][2:4] == ["ab", None]
    assert [x[2] for x in got][4:7] == ["abc def", "abcd", None] and got[1][3] == "12,50" and all(v is None for v in got[7])
    rows = spark.createDataFrame([(i, ["Invoice", "10:20", "total0"] * 5) for i in range(40)], "id int, w array<string>")
    a = rows.select("id", N.noisy(F.col("id"), F.col("w")).alias("n")).collect()
    b = rows.repartition(7).select("id", N.noisy(F.col("id"), F.col("w")).alias("n")).collect()
    assert dict(a) == dict(b) and 5 < sum(x.n is not None for x in a) < 35


def test_deskew(spark):
    t = math.tan(math.radians(3))
    rows = [(1, [0.0, y], [200.0, y + 200 * t], [200.0, y + 200 * t + 10], [0.0, y + 10], 0.9) for y in (0.0, 30.0, 60.0)] + [(2, [0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], 0.9)]
    got = {r.d: r for r in L.deskew(spark.createDataFrame(rows, "d int, p0 array<double>, p1 array<double>, p2 array<double>, p3 array<double>, confidence double"), "d").collect()}
    assert abs(got[1].text_angle - 3) < 1e-6 and got[1].supported == 3 and got[1].reliability > 0.8
    assert (got[2].text_angle, got[2].reliability, got[2].dispersion) == (0.0, 0.0, 90.0)


def test_rules_of_reports_and_redaction(spark):
    row = {"build_id": "b", "split": "train", "manifest_sha256": "a" * 64, "checkpoint_sha256": None, "source_commit": "abcdef1", "sample_count": 2, "failure_count": 3, "duration_seconds": None, "private_row_count": 1}
    df = spark.createDataFrame([row], "build_id string, split string, manifest_sha256 string, checkpoint_sha256 string, source_commit string, sample_count int, failure_count int, duration_seconds double, private_row_count int")
    assert df.select(V.violations(V.report_rules())).first()[0] == ["failure_count", "duration_seconds", "private_row_count"]
    t = spark.createDataFrame([("see r7.pdf in /home/x; r7_output; xr7; r7",)], "t string")
    assert t.select(V.redact(F.col("t"), ["/home/x", "r7.pdf"], "r7")).first()[0] == "see <private> in <private>; <private>_output; xr7; <private>"
    with pytest.raises(Exception, match="private row"):
        spark.createDataFrame([(None, 1)], "p boolean, v int").select(V.public_only(F.col("p"), F.col("v"))).collect()


def test_sizes_and_flags(spark):
    df = spark.createDataFrame([(10.0, "Yes "), (2048.0, "n"), (244352.0, None), (5.0 * 1024**3, "1"), (None, "")], "n double, t string")
    got = df.select(X.human_bytes(F.col("n")), X.truth(F.col("t"))).collect()
    assert [x[0] for x in got] == ["10 B", "2.00 KB", "238.62 KB", "5.00 GB", None] and [x[1] for x in got] == [True, False, False, True, False]


def test_orientation_compares_all_angles(spark, tmp_path):
    """Angles that are apart only beyond the twelve smallest, and against all pairs."""
    import random

    from folioflow.plans.catalog import QUERIES

    r = random.Random(6)
    values = {0: [1.0] * 14 + [80.0], 1: [1.0] * 40, 2: [0.0, 90.0, 45.0], 3: [5.0, 175.0, 355.0, -4.0, 184.0], 4: [10.0, 10.0, 10.0, 40.0], 5: [10.0, 10.0, 10.0, 39.999], 6: [float("nan"), float("inf"), 3.0, 90.0, 5.0]}
    for u in range(7, 90):
        start, width = r.uniform(-400, 400), r.uniform(10, 50)
        values[u] = [round(start + r.uniform(0, width) + 180 * r.randrange(3), 3) for _ in range(r.choice([4, 9, 30]))]

    def mixed(v):
        v = [x for x in v if math.isfinite(x)]
        gaps = [min(d, 180 - d) for a in v for b in v for d in [abs(a - b) % 180]]
        return len(v) >= 4 and max(gaps) >= 30 - 1e-9

    spark.createDataFrame([(u, x) for u, v in values.items() for x in v], "user_id int, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {x.user_id: x.mixed for x in QUERIES["orientation_facts"](spark, str(tmp_path)).collect()}
    want = {u: mixed(v) for u, v in values.items()}
    assert got == want and 10 < sum(want.values()) < 80


def test_error_rates_over_all_lines(spark, tmp_path):
    from folioflow.plans.catalog import QUERIES

    rows = [(1, "a", "kitten\nsitting\nsit in\nsit"), (2, "a", "one line"), (3, "b", "x y\nx y\nx z y"), (4, "b", None), (5, "c", "")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {name: {r[0]: tuple(r)[1:] for r in QUERIES[name](spark, str(tmp_path)).collect()} for name in ("cer_pairs", "cer_by_source", "word_errors")}
    # kitten/sitting 3, sitting/sit in 2, sit in/sit 3; a single line against nothing; x y/x y 0, x y/x z y 2
    assert got["cer_pairs"] == {1: (8, 19, 8 / 19), 2: (8, 8, 1.0), 3: (2, 6, 2 / 6), 5: (0, 0, None)}
    assert got["cer_by_source"] == {"a": (16, 27, 16 / 27), "b": (2, 6, 2 / 6), "c": (0, 0, None)}
    assert got["word_errors"] == {"a": (6, 6), "b": (1, 4), "c": (0, 0)}


def test_recognition_over_all_invoice_lines(spark, sf):
    from folioflow.plans.catalog import QUERIES
    from folioflow.sources.lines import invoice_lines

    lines = invoice_lines(spark, sf)
    got = QUERIES["recognition_report"](spark, sf).agg(F.sum("samples"), F.sum("characters")).first()
    assert got[0] == 7 * lines.select("doc_id").distinct().count() > 0
    assert got[1] == lines.where("line_no < 7").select(F.sum(F.length(X.folded(F.col("text"))))).first()[0]
