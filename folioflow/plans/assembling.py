"""Queries of results, keys, candidates, angles and trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.functions import geometry as G
from folioflow.operators import extract as E, metrics as M, records as R
from folioflow.plans.extraction import _CAND, _KV, BY, _candidates
from folioflow.sources.lines import DOCUMENT_SQL, document_lines, invoice_lines
from folioflow.sources.tables import table


def document_results(spark, d):
    """The rendered invoices as validated results: every canonical field, set or null."""
    return R.document_results(E.best_fields(_candidates(spark, d), BY), "doc_id")


def page_texts(spark, d):
    """The documents' lines put together again, forty to a page."""
    l = document_lines(spark, d).withColumn("page_number", (F.col("line_no") / 40).cast("int") + 1)
    return R.page_texts(l, "doc_id", "page_number", "line_no", "text").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").alias("characters"))


def relation_counts(spark, d):
    """Key-value relations of the invoices by what both ends say, over all invoices, for keys that aren't names."""
    e = E.key_values(invoice_lines(spark, d))
    r = E.best_relations(E.relation_candidates(e))
    c = R.relation_counts(e, r, ["doc_id", "page_number"])
    return c.groupBy("relation_type", "source_label", "source_text", "target_label").agg(F.sum("n").alias("n"), F.count_distinct("target_text").alias("targets"))


def token_fields(spark, d):
    """Which critical fields each invoice line is the evidence for."""
    t = R.token_fields(E.best_fields(_candidates(spark, d), BY), ["doc_id", "line_no"], "field")
    return t.select("doc_id", "line_no", F.array_join("fields", ",").alias("fields"))


def transcription_faults(spark, d):
    """Texts, line by line as they stand, that are no transcriptions."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.explode(F.split("text", "\n")).alias("t"))
    return docs.groupBy(F.coalesce(R.transcription_fault(F.col("t")), F.lit("none")).alias("fault")).agg(F.count(F.lit(1)).alias("lines"))


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """Every user's events as readings of a crop: the amount's whole part, in the order of the events."""
    e = table(spark, d, "events")
    return e.select("user_id", F.col("event_id").alias("ordinal"), F.concat(F.lit("N "), F.floor("value").cast("string")).alias("said"), (F.col("event_id") % 89 / F.lit(89.0)).alias("confidence"))


def candidate_records(spark, d):
    c = R.candidate_records(_readings(spark, d), ["user_id"], "ordinal", "said", "confidence", F.lit(False), r"N \d{2,}$")
    return c.select("user_id", "ordinal", "valid_ratio", "script_consistency", "pattern_score", F.round("agreement", 9).alias("agreement"), F.round("score", 9).alias("score"))


def retried_readings(spark, d):
    c = R.candidate_records(_readings(spark, d), ["user_id"], "ordinal", "said", "confidence", F.lit(False)).withColumn("score", F.round("score", 9))
    return R.retried(c, ["user_id"], "ordinal", "confidence").select("user_id", "ordinal", "score", "retried")


def tile_mapping(spark, d):
    """Parts as words read in one of their page's tiles at double size."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"), F.explode(G.tiles((F.col("p_size") * 37 + 200).cast("bigint"), (F.col("p_size") * 53 + 300).cast("bigint"))).alias("t"))
    box = F.array(*[F.lit(float(v)) for v in (10, 20, 110, 50)])
    m = R.tile_to_page(p.withColumn("polygon", G.box_polygon(box)), "t", "p_partkey", "text", "polygon", F.lit(2.0))
    return m.select("p_partkey", F.col("t.tile").alias("tile"), "id", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def restored_boxes(spark, d):
    """Boxes read on turned pages, back on their pages and within them."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 7 % 360).cast("double").alias("angle"), F.array(F.lit(-5.0), F.lit(30.0), (F.col("p_size") * 9 + 20).cast("double"), F.lit(80.0)).alias("box"))
    p = p.withColumn("t", G.rotation(F.lit(400), F.lit(300), F.col("angle"))).withColumn("turned", G.apply(F.col("t.inverse"), G.box_polygon(F.col("box"))))
    b = p.withColumn("back", R.restored(F.col("turned"), F.lit(400), F.lit(300))).withColumn("b", G.polygon_box(F.col("back")))
    return b.select("p_partkey", *[F.round(F.col("b")[i], 6).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def line_alignment(spark, d):
    """Lines as words that slope by their number."""
    turn = F.radians(((F.col("doc_id") + F.col("line_no")) % 7 - 3).cast("double"))
    w = document_lines(spark, d).select("doc_id", F.array(F.lit(0.0), F.lit(0.0)).alias("p0"), F.array(100 * F.cos(turn), 100 * F.sin(turn)).alias("p1"))
    return R.line_alignment(w, "doc_id").withColumn("line_alignment", F.round("line_alignment", 9))


def seeded_angles(spark, d):
    """An angle for every order in three epochs, three fifths of them upright."""
    o = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(*map(F.lit, range(3)))).alias("epoch"))
    return o.select("o_orderkey", "epoch", R.seeded_angle(F.col("o_orderkey"), F.col("epoch"), 0.6, [90, 180, 270, 15, 345]).alias("angle"))


def angle_grids(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("low"), (F.col("p_size") + F.col("p_partkey") % 5 - 1).cast("double").alias("high"))
    return p.select("p_partkey", F.explode(R.angle_grid(F.col("low"), F.col("high"), 0.5)).alias("angle"))


def runner_ups(spark, d):
    """Items of an order as angle candidates: the quantity is the angle, the price the score."""
    i = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("double").alias("angle"), F.col("l_extendedprice").cast("double").alias("score")).distinct()
    return R.separated_runner_up(i, ["l_orderkey"], "angle", "score", 2.0)


def boundary_errors(spark, d):
    e = table(spark, d, "events")
    truth = (F.col("event_id") % 360).cast("double")
    near = F.least(truth % 90, 90 - truth % 90) <= 10
    return R.boundary_errors(e, ["event_type"], M.rotation_zone(truth), M.rotation_zone(F.col("value")), near)


def configuration_hashes(spark, d):
    """Suppliers as settings: names of any script, a number and a null."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    v = {"name": F.concat(F.col("s_name"), F.lit(" ü/\"ไ")), "nation": F.col("s_nationkey").cast("bigint"), "active": F.col("s_nationkey") % 2 == 0, "missing": F.lit(None).cast("string")}
    return s.select("s_suppkey", R.canonical_json(v).alias("canonical"), R.configuration_hash(v).alias("hash"))


_PARTS = {"detector": ("detector_model", "detector_artifact_hash"), "recognizer": ("recognizer_model", "recognizer_artifact_hash"), "preprocessing": ("preprocessing_version",)}


def _stack() -> dict:
    k = F.col("p_partkey")
    return {
        "input_sha256": F.sha2(k.cast("string"), 256), "detector_model": F.col("p_brand"), "detector_artifact_hash": F.sha2(F.col("p_brand"), 256), "recognizer_model": F.col("p_type"), "recognizer_artifact_hash": F.sha2(F.col("p_type"), 256),
        "language_route_configuration": F.create_map(F.lit("mode"), F.lit("auto")), "orientation_configuration": F.create_map(F.lit("angle"), (k % 4 * 90).cast("int")), "paddleocr_version": F.lit("3.0"), "preprocessing_version": F.concat(F.lit("v"), (F.col("p_size") % 3).cast("string")),
    }


def cache_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", R.cache_key(_stack()).alias("cache_key"))


def stack_bindings(spark, d):
    """Every part's recognition stack against the one of the smallest part number: which bindings differ."""
    b = table(spark, d, "part").select("p_partkey", *[v.alias(n) for n, v in R.stack_binding(_stack(), _PARTS).items()])
    first = b.orderBy("p_partkey").limit(1)
    j = b.alias("a").crossJoin(F.broadcast(first).alias("e"))
    return j.select(F.col("a.p_partkey").alias("p_partkey"), F.array_join(R.binding_mismatches("a", "e", _PARTS), ",").alias("mismatches"))


def _trials(spark: SparkSession, d: str) -> DataFrame:
    """Months as trials, their figures from the items shipped in them."""
    m = lambda c, size: F.round(F.sum(F.col(c).cast("decimal(14,2)")).cast("double") / F.count(F.lit(1)) * size, 6)
    n = F.count(F.lit(1))
    return table(spark, d, "lineitem").groupBy(F.month("l_shipdate").alias("month")).agg(
        m("l_quantity", 0.018).alias("wer"), m("l_discount", 9).alias("amount_exact"), m("l_tax", 11).alias("date_exact"), F.when(n % 2 == 0, m("l_tax", 5)).alias("identifier_exact"), F.lit(None).cast("double").alias("currency_exact"),
        m("l_discount", 7).alias("email_exact"), m("l_discount", 8).alias("numeric_exact"), m("l_tax", 9).alias("english_exact"), m("l_tax", 13).alias("turkish_accuracy"), (n % 3 / F.lit(2.0)).alias("seconds"), (n % 5 > 0).alias("confidence_finite"),
        (n % 7 > 0).alias("export_reload_passed"), F.lit(True).alias("dictionary_match_passed"), (n % 11 == 0).cast("int").alias("private_rows"),
    )


def recognizer_gates(spark, d):
    """Every trial against the first month's, by all ten criteria."""
    t = _trials(spark, d)
    first = F.broadcast(t.orderBy("month").limit(1)).alias("b")
    g = M.recognizer_gate("b", "c", 0.5, (R.critical_exact_score("b"), R.critical_exact_score("c")))
    return t.alias("c").crossJoin(first).select(F.col("c.month").alias("trial"), *[v.alias(k) for k, v in g.items()], F.round(R.critical_exact_score("c"), 9).alias("critical_exact_score"), M.accepted(g).alias("accepted"))


def detector_gates(spark, d):
    """Every trial as a detector against the first month's, by all nine criteria."""
    t = _trials(spark, d).select("month", F.col("amount_exact").alias("f1"), F.col("date_exact").alias("critical_recall"), F.col("private_rows").alias("failures"), "seconds", "private_rows", "export_reload_passed",
                                 F.col("confidence_finite").alias("adapter_contract_passed"), F.lit(True).alias("rotated_page_passed"), F.col("dictionary_match_passed").alias("blank_low_text_passed"))
    g = M.detector_gate("b", "c", 0.5)
    return t.alias("c").crossJoin(F.broadcast(t.orderBy("month").limit(1)).alias("b")).select(F.col("c.month").alias("trial"), *[v.alias(k) for k, v in g.items()], M.accepted(g).alias("accepted"))


def error_ranking(spark, d):
    """Errors of the newest state of every end-to-end report by priority; the longer the name, the harder to mend."""
    r = table(spark, d, "locked_test_end_to_end_metrics").groupBy("report_id").agg(F.max_by(F.struct("error_counts", "sample_count"), F.struct("recorded_at", "ingested_at")).alias("m"))
    e = r.select("report_id", F.col("m.sample_count").alias("samples"), F.explode("m.error_counts").alias("error", "n")).where("n IS NOT NULL")
    s = e.groupBy("error").agg(F.sum("n").alias("n"), F.sum("samples").alias("samples"))
    k = R.error_ranking(s, "n", "samples", F.lit(3), 1 / F.length("error"))
    return k.select("error", "n", "samples", F.round("frequency", 9).alias("frequency"), F.round("priority", 9).alias("priority"))


def storage_reserves(spark, d):
    """Bytes of each dataset's files, planned twice over, against a fixed disk."""
    b = table(spark, d, "raw_baseline").groupBy("baseline_run").agg(F.sum("size_bytes").alias("bytes"))
    r = R.storage_reserve(F.lit(60_000_000), F.col("bytes") * 2, F.lit(20_000_000))
    return b.select("baseline_run", "bytes", *[v.alias(k) for k, v in r.items()])


def selective_accuracy(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("event_id") % 997 / F.lit(997.0)).alias("c"), (F.col("event_id") % 13 < 9).alias("ok"))
    s = R.selective_accuracy(e, ["event_type"], "c", F.col("ok"), 0.6)
    return s.select("event_type", "n", *[F.round(c, 9).alias(c) for c in ("coverage", "selective_accuracy", "nll")])


def nation_mentions(spark, d):
    return R.mentioned(table(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "text", table(spark, d, "nation").unionByName(table(spark, d, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.lit("in").alias("n_name")).limit(1), allowMissingColumns=True), "n_name")


def history_rows(spark, d):
    """Nested metrics of the reports as flat rows, each report's newest state."""
    r = table(spark, d, "locked_test_end_to_end_metrics").where("report_id IS NOT NULL").groupBy("report_id").agg(F.max_by(F.struct("metrics", "sample_count"), F.struct("recorded_at", "ingested_at")).alias("m"))
    return r.select("report_id", F.col("m.sample_count").alias("sample_count"), "m.metrics.*")


def selected_trials(spark, d):
    """Whether each role of a registry has exactly one selected model, and that one is available and accepted."""
    r = table(spark, d, "model_registry").groupBy("registry_id").agg(F.max_by("models", F.struct("recorded_at", "ingested_at")).alias("m")).select("registry_id", F.explode("m").alias("name", "v")).where("v IS NOT NULL AND v.role IS NOT NULL")
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    return R.best_allowed(r.withColumn("role", F.col("v.role")), ["registry_id", "role"], on("v.selected"), on("v.available") & on("v.accepted"))


QUERIES = {f.__name__: f for f in (
    document_results, page_texts, relation_counts, token_fields, transcription_faults, candidate_records, retried_readings, tile_mapping, restored_boxes, line_alignment, seeded_angles, angle_grids, runner_ups, boundary_errors,
    configuration_hashes, cache_keys, stack_bindings, recognizer_gates, detector_gates, error_ranking, storage_reserves, selective_accuracy, nation_mentions, history_rows, selected_trials,
)}
_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY recorded_at DESC, ingested_at DESC) AS i FROM locked_test_end_to_end_metrics WHERE report_id IS NOT NULL) WHERE i = 1)"
_READ = """c AS (SELECT user_id, event_id AS ordinal, 'N ' || floor(value)::BIGINT AS said, (event_id % 89) / 89.0::DOUBLE AS confidence FROM events),
  k AS (SELECT *, (row_number() OVER (PARTITION BY user_id, said ORDER BY ordinal) - 1) / greatest(1, row_number() OVER (PARTITION BY user_id ORDER BY ordinal) - 1)::DOUBLE AS agreement FROM c)"""
_KEY = """'{"detector_artifact_hash":"' || sha256(p_brand) || '","detector_model":"' || p_brand || '","input_sha256":"' || sha256(p_partkey::VARCHAR) || '","language_route_configuration":{"mode":"auto"},"orientation_configuration":{"angle":' || (p_partkey % 4 * 90)
  || '},"paddleocr_version":"3.0","preprocessing_version":"v' || (p_size % 3) || '","recognizer_artifact_hash":"' || sha256(p_type) || '","recognizer_model":"' || p_type || '"}'"""
_TRIALS = """t AS (SELECT month(l_shipdate)::INT AS month, count(*) AS n, sum(l_quantity::DECIMAL(14,2))::DOUBLE / count(*) AS q, sum(l_discount::DECIMAL(14,2))::DOUBLE / count(*) AS a, sum(l_tax::DECIMAL(14,2))::DOUBLE / count(*) AS x FROM lineitem GROUP BY 1),
  v AS (SELECT month, n, round(q * 0.018, 6) AS wer, round(a * 9, 6) AS amount, round(x * 11, 6) AS date, CASE WHEN n % 2 = 0 THEN round(x * 5, 6) END AS ident, round(a * 7, 6) AS email, round(a * 8, 6) AS num, round(x * 9, 6) AS english, round(x * 13, 6) AS turkish, (n % 3) / 2.0::DOUBLE AS seconds FROM t),
  s AS (SELECT *, (amount + date + coalesce(ident, 0) + email) / (3 + (ident IS NOT NULL)::INT) AS crit FROM v), b AS (SELECT * FROM s ORDER BY month LIMIT 1)"""
_FIELD_STRUCT = ", ".join(f"'{f}': max(CASE WHEN field = '{f}' THEN value END)" for f in R.FIELDS)
_CRITICAL = ", ".join(repr(f) for f in R.CRITICAL_FIELDS)
_CLAMP = "greatest(0, least(1, {}))"
ORACLES = {
    "document_results": f"""WITH {_CAND} SELECT doc_id, '1.0' AS schema_version, coalesce(max(CASE WHEN field = 'document_title' THEN value END), 'unknown') AS document_type, to_json({{{_FIELD_STRUCT}}})::VARCHAR AS fields, count(*) AS present, '' AS broken FROM best WHERE r = 1 GROUP BY 1""",
    "page_texts": rf"""WITH {DOCUMENT_SQL}, p AS (SELECT doc_id, line_no // 40 + 1 AS page, trim(string_agg(text, chr(10) ORDER BY line_no), ' ') AS t FROM lines GROUP BY 1, 2), w AS (SELECT doc_id, trim(string_agg('--- Page ' || page || ' ---' || chr(10) || t, chr(10) || chr(10) ORDER BY page), ' ') AS w FROM p GROUP BY 1)
        SELECT doc_id, md5(w) AS digest, length(w) AS characters FROM w""",
    "relation_counts": f"""WITH {_KV}, ext AS (SELECT doc_id, max(greatest(ex1, ey1)) AS extent FROM ent GROUP BY 1),
        c AS (SELECT s.doc_id, s.entity_text AS st, t.entity_text AS tt, s.entity_id AS sid, t.entity_id AS tid, sqrt(((t.ex0 + t.ex1) / 2 - (s.ex0 + s.ex1) / 2) ** 2 + ((t.ey0 + t.ey1) / 2 - (s.ey0 + s.ey1) / 2) ** 2) / greatest(1.0, extent) AS nd,
          (t.ex0 + t.ex1) / 2 >= (s.ex0 + s.ex1) / 2 AS isr, (t.ey0 + t.ey1) / 2 >= (s.ey0 + s.ey1) / 2 AS isb, greatest(s.ey0, t.ey0) <= least(s.ey1, t.ey1) AS sl,
          greatest(0, t.ey0 - s.ey1, s.ey0 - t.ey1) AS vg, greatest(0, t.ex0 - s.ex1, s.ex0 - t.ex1) AS hg FROM ent s JOIN ent t ON s.doc_id = t.doc_id AND s.label = 'KEY' AND t.label = 'VALUE' JOIN ext ON ext.doc_id = s.doc_id),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sid ORDER BY nd + CASE WHEN NOT isr AND NOT isb THEN 0.25 ELSE 0 END - CASE WHEN sl THEN 0.15 ELSE 0 END, vg, hg, tid) AS r FROM c WHERE nd <= 0.6)
        SELECT 'KEY_VALUE' AS relation_type, 'KEY' AS source_label, lower(st) AS source_text, 'VALUE' AS target_label, count(*) AS n, count(DISTINCT lower(tt)) AS targets FROM b WHERE r = 1 GROUP BY ALL""",
    "token_fields": f"WITH {_CAND} SELECT doc_id, line_no, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM best WHERE r = 1 AND field IN ({_CRITICAL}) GROUP BY 1, 2",
    "transcription_faults": r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL)
        SELECT CASE WHEN regexp_replace(t, '[\t\n\x0b\f\r ]+', '', 'g') = '' THEN 'empty' WHEN contains(t, chr(9)) OR contains(t, chr(13)) THEN 'control' ELSE 'none' END AS fault, count(*) AS lines FROM l GROUP BY 1""",
    "candidate_records": f"""WITH {_READ} SELECT user_id, ordinal, 1.0::DOUBLE AS valid_ratio, 1.0::DOUBLE AS script_consistency, regexp_matches(said, 'N \\d{{2,}}$')::INT::DOUBLE AS pattern_score, round(agreement, 9) AS agreement,
        round(0.55 * confidence + 0.25 + 0.15 * regexp_matches(said, 'N \\d{{2,}}$')::INT + 0.05 * agreement, 9) AS score FROM k""",
    "retried_readings": f"""WITH {_READ}, s AS (SELECT *, round(0.55 * confidence + 0.25 + 0.075 + 0.05 * agreement, 9) AS score FROM k), f AS (SELECT user_id, min(ordinal) AS first FROM s GROUP BY 1),
        r AS (SELECT s.*, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, confidence DESC, ordinal) AS i FROM s)
        SELECT user_id, CASE WHEN a.confidence >= 0.65 THEN a.ordinal ELSE r.ordinal END AS ordinal, CASE WHEN a.confidence >= 0.65 THEN a.score ELSE r.score END AS score, a.confidence < 0.65 AS retried FROM f JOIN s a USING (user_id) JOIN r USING (user_id) WHERE a.ordinal = first AND i = 1""",
    "tile_mapping": """WITH p AS (SELECT p_partkey, p_name, p_size * 37 + 200 AS w, p_size * 53 + 300 AS h FROM part), o AS (SELECT *, ceil(w / 2.0::DOUBLE) AS bw, ceil(h / 2.0::DOUBLE) AS bh FROM p), k AS (SELECT unnest([0, 0, 1, 1]) AS r, unnest([0, 1, 0, 1]) AS c),
        t AS (SELECT p_partkey, p_name, r * 2 + c AS tile, greatest(0, bw * c - CASE WHEN c > 0 THEN round_even(bw * 0.15::DOUBLE, 0) ELSE 0 END) AS tx, greatest(0, bh * r - CASE WHEN r > 0 THEN round_even(bh * 0.15::DOUBLE, 0) ELSE 0 END) AS ty FROM o, k)
        SELECT p_partkey, tile, 'tile-word_' || substr(sha256(tile || '|' || p_partkey || '|' || replace(p_name, chr(92), '/') || '|' || (tx + 5)::DECIMAL(20,4) || ',' || (ty + 10)::DECIMAL(20,4) || ',' || (tx + 55)::DECIMAL(20,4) || ',' || (ty + 25)::DECIMAL(20,4)), 1, 16) AS id, tx + 5 AS x0, ty + 10 AS y0, tx + 55 AS x1, ty + 25 AS y1 FROM t""",
    "restored_boxes": """WITH p AS (SELECT p_partkey, cos(radians(p_size * 7 % 360)) AS c, sin(radians(p_size * 7 % 360)) AS s, p_size * 9 + 20 AS bx FROM part), e AS (SELECT *, (abs(c) * 400 + abs(s) * 300) / 2 AS ex, (abs(s) * 400 + abs(c) * 300) / 2 AS ey FROM p),
        t AS (SELECT *, ex - (c * 400 + s * 300) / 2 AS tx, ey - (-s * 400 + c * 300) / 2 AS ty FROM e), q AS (SELECT t.*, unnest([-5, bx, bx, -5]) - tx AS u, unnest([30, 30, 80, 80]) - ty AS v FROM t), r AS (SELECT p_partkey, greatest(0, least(400, c * u - s * v)) AS x, greatest(0, least(300, s * u + c * v)) AS y FROM q)
        SELECT p_partkey, round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x), 6) AS x1, round(max(y), 6) AS y1 FROM r GROUP BY 1""",
    "line_alignment": f"WITH {DOCUMENT_SQL} SELECT doc_id, round(1 - median(abs((doc_id + line_no) % 7 - 3)) / 90.0, 9) AS line_alignment FROM lines GROUP BY 1",
    "seeded_angles": """WITH h AS (SELECT o_orderkey, e AS epoch, sha256('42|' || o_orderkey || '|' || e) AS h FROM orders, (VALUES (0), (1), (2)) v(e))
        SELECT o_orderkey, epoch, CASE WHEN ('0x' || substr(h, 1, 8))::UBIGINT::DOUBLE / 4294967296.0 < 0.6 THEN 0 ELSE [90, 180, 270, 15, 345][(('0x' || substr(h, 9, 8))::UBIGINT % 5 + 1)::BIGINT] END::DOUBLE AS angle FROM h""",
    "angle_grids": "SELECT p_partkey, unnest(list_filter(generate_series(0, 20), lambda i: (i * 0.5 < p_partkey % 5 - 1) OR (i = 0 AND p_partkey % 5 = 1))) * 0.5::DOUBLE + p_size AS angle FROM part",
    "runner_ups": """WITH i AS (SELECT DISTINCT l_orderkey, l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS s FROM lineitem), r AS (SELECT *, row_number() OVER w AS r, first_value(a) OVER w AS top FROM i WINDOW w AS (PARTITION BY l_orderkey ORDER BY s DESC, a)),
        g AS (SELECT l_orderkey, arg_min(a, r) AS ba, arg_min(s, r) AS bs, arg_min(a, r) FILTER (r > 1 AND abs(a - top) >= 8) AS fa, arg_min(s, r) FILTER (r > 1 AND abs(a - top) >= 8) AS fs, arg_min(a, r) FILTER (r > 1) AS sa, arg_min(s, r) FILTER (r > 1) AS ss FROM r GROUP BY 1)
        SELECT l_orderkey, ba AS best_angle, bs AS best_score, coalesce(fa, sa, ba) AS runner_up_angle, coalesce(fs, ss, bs) AS runner_up_score FROM g""",
    "boundary_errors": """WITH z AS (SELECT event_type, event_id % 360 AS t, (event_id % 360) // 90 + 1 AS z, least(4, floor(((value % 360 + 360) % 360) / 90) + 1)::INT AS p FROM events)
        SELECT event_type, CASE WHEN least(t % 90, 90 - t % 90) <= 10 THEN 'boundary' ELSE 'interior' END AS region, count(*) AS n, count(*) FILTER (z = p) AS right, count(*) FILTER (abs(z - p) IN (1, 3)) AS neighbouring, count(*) FILTER (abs(z - p) = 2) AS opposite FROM z GROUP BY 1, 2""",
    "configuration_hashes": r"""WITH j AS (SELECT s_suppkey, '{"active":' || (s_nationkey % 2 = 0) || ',"missing":null,"name":"' || s_name || ' \u00fc/\"\u0e44","nation":' || s_nationkey || '}' AS canonical FROM supplier) SELECT s_suppkey, canonical, substr(sha256(canonical), 1, 16) AS hash FROM j""",
    "cache_keys": f"SELECT p_partkey, sha256({_KEY}) AS cache_key FROM part",
    "stack_bindings": """WITH f AS (SELECT p_brand AS b, p_type AS t, p_size % 3 AS v FROM part ORDER BY p_partkey LIMIT 1) SELECT p_partkey, concat_ws(',', CASE WHEN p_brand <> b THEN 'detector' END, CASE WHEN p_type <> t THEN 'recognizer' END, CASE WHEN p_size % 3 <> v THEN 'preprocessing' END) AS mismatches FROM part, f""",
    "recognizer_gates": f"""WITH {_TRIALS}, g AS (SELECT c.month AS trial, (b.wer - c.wer) / b.wer >= 0.15 - 1e-12 OR c.wer <= 0.45 + 1e-12 AS wer_improvement_or_floor, c.crit - b.crit >= 0.10 - 1e-12 AS critical_field_exact_gain,
        {_CLAMP.format('c.num')} + 1e-12 >= {_CLAMP.format('b.num')} AND {_CLAMP.format('c.amount')} + 1e-12 >= {_CLAMP.format('b.amount')} AS numeric_and_amount_no_regression, {_CLAMP.format('c.english')} + 0.02 + 1e-12 >= {_CLAMP.format('b.english')} AS english_no_material_regression,
        c.turkish BETWEEN 0 AND 1 AND c.turkish + 0.02 + 1e-12 >= b.turkish AS turkish_valid, c.seconds <= 0.5 AS processing_time_acceptable, c.n % 5 > 0 AS confidence_finite, c.n % 7 > 0 AS export_reload_passed, true AS dictionary_match_passed, c.n % 11 > 0 AS no_private_data, round(c.crit, 9) AS critical_exact_score FROM s c, b)
        SELECT *, wer_improvement_or_floor AND critical_field_exact_gain AND numeric_and_amount_no_regression AND english_no_material_regression AND turkish_valid AND processing_time_acceptable AND confidence_finite AND export_reload_passed AND no_private_data AS accepted FROM g""",
    "detector_gates": f"""WITH {_TRIALS}, g AS (SELECT c.month AS trial, c.amount - b.amount >= 0.10 - 1e-12 OR c.amount >= 0.6 - 1e-12 AS f1_improvement_or_floor, c.date + 1e-12 >= b.date AS critical_recall_no_regression, c.n % 11 > 0 AS no_new_failures, c.seconds <= 0.5 AS processing_time_acceptable,
        c.n % 7 > 0 AS export_reload_passed, c.n % 5 > 0 AS adapter_contract_passed, true AS rotated_page_passed, true AS blank_low_text_passed, c.n % 11 > 0 AS no_private_data FROM s c, b)
        SELECT *, f1_improvement_or_floor AND critical_recall_no_regression AND no_new_failures AND processing_time_acceptable AND export_reload_passed AND adapter_contract_passed AS accepted FROM g""",
    "error_ranking": f"""WITH e AS (SELECT sample_count, unnest(map_entries(error_counts)) AS x FROM {_LATEST}), s AS (SELECT x.key AS error, sum(x.value)::BIGINT AS n, sum(sample_count)::BIGINT AS samples FROM e WHERE x.value IS NOT NULL GROUP BY 1)
        SELECT *, round(coalesce(n / nullif(samples, 0)::DOUBLE, 0), 9) AS frequency, round(coalesce(n / nullif(samples, 0)::DOUBLE, 0) * 3 / length(error), 9) AS priority FROM s""",
    "storage_reserves": "SELECT baseline_run, sum(size_bytes)::BIGINT AS bytes, 60000000 - 2 * sum(size_bytes)::BIGINT AS left_after, 60000000 - 2 * sum(size_bytes)::BIGINT >= 20000000 AS keeps_reserve FROM raw_baseline GROUP BY 1",
    "selective_accuracy": """WITH e AS (SELECT event_type, (event_id % 997) / 997.0::DOUBLE AS c, event_id % 13 < 9 AS ok FROM events) SELECT event_type, count(*) AS n, round(count(*) FILTER (c >= 0.6) / count(*)::DOUBLE, 9) AS coverage, round(count(*) FILTER (c >= 0.6 AND ok) / count(*) FILTER (c >= 0.6)::DOUBLE, 9) AS selective_accuracy,
        round(avg(-ln(greatest(1e-12, least(1.0, CASE WHEN ok THEN c ELSE 1 - c END)))), 9) AS nll FROM e GROUP BY 1""",
    "nation_mentions": "WITH n AS (SELECT DISTINCT n_name FROM (SELECT n_name FROM nation UNION ALL SELECT 'in')) SELECT n_name, count(DISTINCT doc_id) AS texts FROM documents JOIN n ON contains(lower(text), lower(n_name)) GROUP BY 1",
    "history_rows": f"SELECT report_id, sample_count, metrics.entity_f1, metrics.relation_f1, metrics.canonical_field_accuracy, metrics.document_type_accuracy, metrics.processing_time_per_page_seconds FROM {_LATEST}",
    "selected_trials": """WITH r AS (SELECT registry_id, models FROM (SELECT *, row_number() OVER (PARTITION BY registry_id ORDER BY recorded_at DESC, ingested_at DESC) AS i FROM model_registry) WHERE i = 1), m AS (SELECT registry_id, unnest(map_values(models)) AS v FROM r),
        g AS (SELECT registry_id, v.role AS role, count(*) FILTER (v.selected) AS selected, count(*) FILTER (v.selected AND v.available AND v.accepted) AS eligible FROM m WHERE v IS NOT NULL AND v.role IS NOT NULL GROUP BY 1, 2)
        SELECT *, CASE WHEN selected = 0 THEN 'none_selected' WHEN selected > 1 THEN 'several_selected' WHEN eligible = 0 THEN 'not_eligible' END AS fault FROM g""",
}
