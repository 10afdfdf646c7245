"""Evaluation queries: text distance, calibration, thresholds, clustering, angles, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.functions.text import tokens, word_distance
from folioflow.operators import metrics as M
from folioflow.sources.tables import current_rows, table


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each document's lines as references and the lines after them as predictions (of a single line, an empty one)."""
    lines = F.split("text", "\n")
    n = F.greatest(F.lit(1), F.size(lines) - 1)
    after = F.when(F.size(lines) > 1, F.slice(lines, 2, n)).otherwise(F.array(F.lit("")))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "source", F.arrays_zip(F.slice(lines, 1, n).alias("previous"), after.alias("line")).alias("pairs"))


def cer_pairs(spark, d):
    total = lambda f: F.aggregate(F.transform("pairs", f), F.lit(0).cast("long"), lambda acc, x: acc + x)
    p = _pairs(spark, d).select("doc_id", total(lambda p: M.character_errors(p.previous, p.line)).alias("errors"), total(lambda p: F.length(p.previous)).alias("characters"))
    return p.withColumn("cer", M.ratio(F.col("errors"), F.col("characters")))


def cer_by_source(spark, d):
    """Corpus error rate per source: summed errors over summed characters."""
    p = _pairs(spark, d).select("source", F.inline("pairs")).select("source", M.character_errors(F.col("previous"), F.col("line")).alias("e"), F.length("previous").alias("n"))
    return p.groupBy("source").agg(F.sum("e").alias("errors"), F.sum("n").alias("characters"), M.ratio(F.sum("e"), F.sum("n")).alias("cer"))


def word_errors(spark, d):
    p = _pairs(spark, d).select("source", F.inline("pairs")).select("source", word_distance(F.col("previous"), F.col("line")).alias("e"), F.size(F.filter(F.split(F.trim("previous"), r"\s+"), lambda x: x != "")).alias("n"))
    return p.groupBy("source").agg(F.sum("e").alias("errors"), F.sum("n").alias("words"))


def multiset_f1(spark, d):
    """Words of eval items against words of documents of the same language, per language."""
    items, docs = table(spark, d, "eval_items"), table(spark, d, "documents")
    a = items.where("lang IS NOT NULL").select("lang", F.explode(tokens(F.replace(F.col("text"), F.lit("İ"), F.lit("i")))).alias("w"))
    b = docs.where("lang IS NOT NULL").select("lang", F.explode(tokens(F.replace(F.col("text"), F.lit("İ"), F.lit("i")))).alias("w"))
    return M.multiset_match(a, b, ["lang"], "w")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Events as predictions: a label, a prediction and a confidence, all from the row."""
    e = table(spark, d, "events")
    return e.select(
        "event_id", (F.col("event_id") % 4).cast("int").alias("label"), F.when(F.col("event_id") % 11 < 8, F.col("event_id") % 4).otherwise((F.col("event_id") * 7) % 4).cast("int").alias("prediction"), (F.col("event_id") % 1009 / F.lit(1009.0)).alias("confidence")
    )


def ece_brier(spark, d):
    s = _scored(spark, d).withColumn("ok", (F.col("label") == F.col("prediction")).cast("int"))
    a = M.ece(s, "confidence", "ok", 15).select(F.lit(15).alias("bins"), "ece", "brier", "n")
    return a.unionByName(M.ece(s, "confidence", "ok", 10).select(F.lit(10).alias("bins"), "ece", "brier", "n")).withColumns({"ece": F.round("ece", 9), "brier": F.round("brier", 9)})


def threshold_sweep(spark, d):
    s = _scored(spark, d)
    p = M.best_positive_threshold(s, "confidence", "prediction", "label").select(F.lit("positive_f1").alias("rule"), F.round("threshold", 9).alias("threshold"), F.round("f1", 9).alias("score"))
    c = M.best_coverage_threshold(s.withColumn("ok", F.col("label") == F.col("prediction")), "confidence", "ok").select(F.lit("coverage").alias("rule"), F.round("threshold", 9).alias("threshold"), F.round("accuracy", 9).alias("score"))
    return p.unionByName(c)


def abstention_f1(spark, d):
    return M.positive_f1(_scored(spark, d), "confidence", "prediction", "label", 0.3).withColumn("f1", F.round("f1", 9))


def label_confusion(spark, d):
    return M.class_scores(M.contingency(_scored(spark, d), "label", "prediction")).select("cls", "support", "predicted", "tp", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"))


def clustering_report(spark, d):
    t = M.clustering_scores(M.contingency(_scored(spark, d), "label", "prediction"))
    return t.select(*[F.round(c, 9).alias(c) for c in t.columns])


def cluster_mapping(spark, d):
    s = _scored(spark, d).withColumn("cluster", (F.col("prediction") + 1) % 4)
    return M.best_mapping(M.contingency(s, "label", "cluster"), 4)


def class_weights(spark, d):
    counts = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return M.inverse_sqrt_weights(counts, "label", "n").withColumn("weight", F.round("weight", 9))


def angle_metrics(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("value").alias("angle"), (F.col("event_id") % 360).cast("double").alias("truth"))
    r = e.withColumn("error", M.circular_error(F.col("angle"), F.col("truth")))
    s = M.angle_summary(r, ["event_type"], "error")
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


def angle_zones(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(M.rotation_zone(F.col("value")).alias("zone"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def weighted_median(spark, d):
    e = table(spark, d, "events").select("user_id", "value", (F.col("event_id") % 5 + 1).cast("double").alias("w"))
    return M.weighted_median(e, ["user_id"], "value", "w")


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """End-to-end reports per dataset as trial rows."""
    r = current_rows(table(spark, d, "locked_test_end_to_end_metrics").select("report_id", "recorded_at", "ingested_at", "metrics.*", "duration_seconds", "sample_count"), "report_id", ["entity_f1", "relation_f1", "canonical_field_accuracy", "document_type_accuracy", "processing_time_per_page_seconds", "sample_count"])
    return r.select("report_id", F.col("entity_f1"), "relation_f1", F.col("canonical_field_accuracy").alias("canonical_accuracy"), F.col("document_type_accuracy").alias("coverage"), F.lit(0.5).alias("detection_f1"), F.lit(0.4).alias("wer"), F.lit(0.3).alias("critical_exact"), F.lit(0.02).alias("failure_rate"), (F.lit(0.1) / F.col("processing_time_per_page_seconds")).alias("efficiency"), "sample_count")


def selection_scores(spark, d):
    return _reports(spark, d).select("report_id", *[F.round(M.selection_score(n), 9).alias(f"{n}_score") for n in ("ocr_model", "preprocessing", "padding")])


def acceptance_gates(spark, d):
    """Every report against the one of the smallest id, as a detector would be judged."""
    r = _reports(spark, d).where("entity_f1 IS NOT NULL AND relation_f1 IS NOT NULL").select("report_id", F.col("entity_f1").alias("f1"), F.col("relation_f1").alias("critical_recall"), F.lit(0).alias("failures"), F.lit(0.5).alias("seconds"))
    g = M.detector_measures("b", "c", 1.0)
    j = r.alias("c").join(F.broadcast(r.orderBy("report_id").limit(1)).alias("b"), F.col("c.report_id") > F.col("b.report_id"))
    return j.select(F.col("c.report_id").alias("report_id"), *[v.alias(k) for k, v in g.items()], M.accepted(g).alias("accepted"))


def report_regressions(spark, d):
    r = _reports(spark, d)
    base = r.where("entity_f1 IS NOT NULL AND relation_f1 IS NOT NULL").orderBy("report_id").limit(1)
    return M.regressions(r.select("report_id", "entity_f1", "relation_f1"), base, ["entity_f1", "relation_f1"])


def simplest_configuration(spark, d):
    """Return flags as configurations scored by their mean discount."""
    s = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_tax").cast("decimal(12,2)")).cast("double") / F.count(F.lit(1)) * 10, 6).alias("score"))
    return M.simplest_material(s, "l_returnflag", "score", {"A": 0, "N": 1, "R": 2}, "A")


def angle_retention(spark, d):
    e = table(spark, d, "events").groupBy("event_type", (F.col("event_id") % 4 * 90).alias("angle")).agg(F.round(F.avg("value"), 6).alias("score"))
    return M.retention(e, ["event_type"], "angle", "score").withColumn("retention", F.round("retention", 6))


QUERIES = {f.__name__: f for f in (
    cer_pairs, cer_by_source, word_errors, multiset_f1, ece_brier, threshold_sweep, abstention_f1, label_confusion, clustering_report, cluster_mapping, class_weights, angle_metrics, angle_zones, weighted_median,
    selection_scores, acceptance_gates, report_regressions, simplest_configuration, angle_retention,
)}
_S = """s AS (SELECT event_id, event_id % 4 AS label, CASE WHEN event_id % 11 < 8 THEN event_id % 4 ELSE (event_id * 7) % 4 END AS prediction, (event_id % 1009) / 1009.0::DOUBLE AS confidence FROM events)"""
_ERR = "least(abs((value % 360 + 360) % 360 - event_id % 360), 360 - abs((value % 360 + 360) % 360 - event_id % 360))"
_R = """r AS (SELECT report_id, metrics.entity_f1 AS entity_f1, metrics.relation_f1 AS relation_f1, metrics.canonical_field_accuracy AS ca, metrics.document_type_accuracy AS cov, 0.1 / metrics.processing_time_per_page_seconds AS eff FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY recorded_at DESC, ingested_at DESC) AS i FROM locked_test_end_to_end_metrics) WHERE i = 1)"""
_C = "greatest(0.0, least(1.0, coalesce({}, 0.0)))"
ORACLES = {
    "multiset_f1": r"""WITH a AS (SELECT lang, unnest(regexp_extract_all(lower(replace(text, 'İ', 'i')), '[\p{L}\p{N}_]+')) AS w FROM eval_items WHERE lang IS NOT NULL), b AS (SELECT lang, unnest(regexp_extract_all(lower(replace(text, 'İ', 'i')), '[\p{L}\p{N}_]+')) AS w FROM documents WHERE lang IS NOT NULL),
        l AS (SELECT lang, w, count(*) AS n FROM a GROUP BY 1, 2), r AS (SELECT lang, w, count(*) AS n FROM b GROUP BY 1, 2), j AS (SELECT coalesce(l.lang, r.lang) AS lang, coalesce(l.n, 0) AS nl, coalesce(r.n, 0) AS nr FROM l FULL JOIN r ON l.lang = r.lang AND l.w = r.w),
        g AS (SELECT lang, sum(least(nl, nr))::BIGINT AS tp, sum(nl)::BIGINT AS expected, sum(nr)::BIGINT AS predicted FROM j GROUP BY 1)
        SELECT *, CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE ELSE 0 END AS precision, CASE WHEN expected > 0 THEN tp / expected::DOUBLE ELSE 0 END AS recall, CASE WHEN expected + predicted > 0 THEN 2 * tp / (expected + predicted)::DOUBLE ELSE 0 END AS f1 FROM g""",
    "ece_brier": f"""WITH {_S}, k AS (SELECT unnest([10, 15]) AS bins), b AS (SELECT bins, least(bins - 1, floor(confidence * bins)) AS bin, sum(confidence) AS c, sum(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END) AS y, count(*) AS n, sum((confidence - CASE WHEN label = prediction THEN 1 ELSE 0 END) ** 2) AS sq FROM s, k GROUP BY 1, 2)
        SELECT bins, round(sum(abs(c - y)) / sum(n), 9) AS ece, round(sum(sq) / sum(n), 9) AS brier, sum(n)::BIGINT AS n FROM b GROUP BY 1""",
    "threshold_sweep": f"""WITH {_S}, g AS (SELECT confidence AS t, count(*) FILTER (prediction > 0 AND label > 0 AND prediction = label) AS tp, count(*) FILTER (prediction > 0 AND NOT (label > 0 AND prediction = label)) AS fp, count(*) AS kept, count(*) FILTER (label = prediction) AS ok, count(*) FILTER (prediction > 0) AS pos FROM s GROUP BY 1),
        w AS (SELECT t, pos, sum(tp) OVER (ORDER BY t DESC) AS tp, sum(fp) OVER (ORDER BY t DESC) AS fp, sum(kept) OVER (ORDER BY t DESC) AS kept, sum(ok) OVER (ORDER BY t DESC) AS ok FROM g), n AS (SELECT count(*) AS n, count(*) FILTER (label > 0) AS p FROM s),
        a AS (SELECT t, 2 * tp / (tp + fp + p)::DOUBLE AS f FROM w, n WHERE pos > 0 ORDER BY f DESC, t DESC LIMIT 1), b AS (SELECT t, ok / kept::DOUBLE AS a FROM w, n WHERE kept / n::DOUBLE + 1e-12 >= 0.9 ORDER BY a DESC, t DESC LIMIT 1)
        SELECT 'positive_f1' AS rule, round(t, 9) AS threshold, round(f, 9) AS score FROM a UNION ALL SELECT 'coverage', round(t, 9), round(a, 9) FROM b""",
    "abstention_f1": f"""WITH {_S}, p AS (SELECT label, CASE WHEN confidence >= 0.3 THEN prediction ELSE 0 END AS p FROM s), g AS (SELECT count(*) FILTER (label > 0 AND p = label) AS tp, count(*) FILTER (NOT (label > 0 AND p = label) AND p > 0) AS fp, count(*) FILTER (NOT (label > 0 AND p = label) AND label > 0) AS fn FROM p)
        SELECT tp, fp, fn, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS f1 FROM g""",
    "label_confusion": f"""WITH {_S}, c AS (SELECT unnest([0, 1, 2, 3]) AS cls), g AS (SELECT cls, count(*) FILTER (label = cls) AS support, count(*) FILTER (prediction = cls) AS predicted, count(*) FILTER (label = cls AND prediction = cls) AS tp FROM c, s GROUP BY 1)
        SELECT *, round(tp / predicted::DOUBLE, 9) AS precision, round(tp / support::DOUBLE, 9) AS recall, round(2 * tp / (predicted + support)::DOUBLE, 9) AS f1 FROM g""",
    "clustering_report": f"""WITH {_S}, t AS (SELECT label, prediction, count(*)::DOUBLE AS n FROM s GROUP BY 1, 2), a AS (SELECT label, sum(n) AS a FROM t GROUP BY 1), b AS (SELECT prediction, sum(n) AS b, max(n) AS top FROM t GROUP BY 1), n AS (SELECT sum(n) AS nn FROM t),
        x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS ij, (SELECT sum(a * (a - 1) / 2) FROM a) AS sa, (SELECT sum(b * (b - 1) / 2) FROM b) AS sb, (SELECT sum(top) FROM b) AS tops, nn, (SELECT -sum(a / nn * ln(a / nn)) FROM a, n) AS ha, (SELECT -sum(b / nn * ln(b / nn)) FROM b, n) AS hb,
          (SELECT sum(t.n / nn * ln(t.n * nn / (a * b))) FROM t JOIN a USING (label) JOIN b USING (prediction), n) AS mi FROM n)
        SELECT round(tops / nn, 9) AS purity, round((ij - sa * sb / (nn * (nn - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (nn * (nn - 1) / 2)), 9) AS adjusted_rand, round(mi, 9) AS mutual_information, round(mi / ha, 9) AS homogeneity, round(mi / hb, 9) AS completeness,
        round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 9) AS v_measure, round(mi / ((ha + hb) / 2), 9) AS normalized_mutual_information FROM x""",
    "cluster_mapping": "SELECT * FROM (VALUES (0, 3), (1, 0), (2, 1), (3, 2)) m(predicted, truth)",
    "class_weights": """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), w AS (SELECT *, greatest(0.25, least(4.0, sqrt(sum(n) OVER () / (count(*) OVER () * n::DOUBLE)))) AS r FROM c) SELECT label, n, round(r / avg(r) OVER (), 9) AS weight FROM w""",
    "angle_metrics": f"""WITH e AS (SELECT event_type, {_ERR} AS e FROM events) SELECT event_type, count(*) AS attempted, count(e) AS estimated, round(avg(e), 6) AS mean_error, round(median(e), 6) AS median_error, round(stddev_pop(e), 6) AS std_error, round(sqrt(avg(e * e)), 6) AS rms_error, round(max(e), 6) AS max_error,
        round(count(*) FILTER (e <= 1) / count(e)::DOUBLE, 6) AS within_1, round(count(*) FILTER (e <= 2) / count(e)::DOUBLE, 6) AS within_2, round(count(*) FILTER (e <= 5) / count(e)::DOUBLE, 6) AS within_5, round(count(*) FILTER (e <= 10) / count(e)::DOUBLE, 6) AS within_10 FROM e GROUP BY 1""",
    "angle_zones": "SELECT least(4, floor(((value % 360 + 360) % 360) / 90) + 1)::INTEGER AS zone, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "weighted_median": """WITH g AS (SELECT user_id, value, sum(event_id % 5 + 1)::DOUBLE AS w FROM events GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY user_id ORDER BY value) AS cum, sum(w) OVER (PARTITION BY user_id) AS whole FROM g) SELECT user_id, min(value) AS weighted_median FROM c WHERE cum >= whole / 2 - 1e-9 GROUP BY 1""",
    "selection_scores": f"""WITH {_R} SELECT report_id, round(0.20 * 0.5 + 0.15 * {_C.format('cov')} + 0.10 * 0.6 + 0.15 * 0.3 + 0.15 * {_C.format('entity_f1')} + 0.10 * {_C.format('ca')} + 0.05 * {_C.format('relation_f1')} + 0.05 * {_C.format('eff')} + 0.05 * 0.98, 9) AS ocr_model_score,
        round(0.30 * 0.5 + 0.25 * {_C.format('cov')} + 0.15 * 0.6 + 0.20 * 0.3 + 0.10 * {_C.format('eff')}, 9) AS preprocessing_score, round(0.40 * 0.3 + 0.20 * {_C.format('cov')} + 0.15 * 0.6 + 0.10 * {_C.format('entity_f1')} + 0.05 * {_C.format('ca')} + 0.05 * {_C.format('eff')} + 0.05 * 0.98, 9) AS padding_score FROM r""",
    "acceptance_gates": f"""WITH {_R}, q AS (SELECT * FROM r WHERE entity_f1 IS NOT NULL AND relation_f1 IS NOT NULL), g AS (SELECT c.report_id, c.entity_f1 - b.entity_f1 >= 0.1 - 1e-12 OR c.entity_f1 >= 0.6 - 1e-12 AS f1_improvement_or_floor, c.relation_f1 + 1e-12 >= b.relation_f1 AS critical_recall_no_regression FROM q c JOIN (SELECT * FROM q ORDER BY report_id LIMIT 1) b ON c.report_id > b.report_id)
        SELECT *, true AS no_new_failures, true AS processing_time_acceptable, f1_improvement_or_floor AND critical_recall_no_regression AS accepted FROM g""",
    "report_regressions": f"""WITH {_R}, b AS (SELECT entity_f1 AS be, relation_f1 AS br FROM r WHERE entity_f1 IS NOT NULL AND relation_f1 IS NOT NULL ORDER BY report_id LIMIT 1), g AS (SELECT report_id, entity_f1, relation_f1, coalesce(entity_f1 + 0.02 + 1e-12 < be, false) AS e, coalesce(relation_f1 + 0.02 + 1e-12 < br, false) AS l FROM r, b)
        SELECT report_id, entity_f1, relation_f1, concat_ws(',', CASE WHEN e THEN 'entity_f1' END, CASE WHEN l THEN 'relation_f1' END) AS regressed, NOT e AND NOT l AS passed FROM g""",
    "simplest_configuration": """WITH s AS (SELECT l_returnflag, round(sum(l_tax::DECIMAL(12,2))::DOUBLE / count(*) * 10, 6) AS score FROM lineitem GROUP BY 1), b AS (SELECT max(score) AS best, max(score) FILTER (l_returnflag = 'A') AS base FROM s)
        SELECT l_returnflag, score FROM s, b WHERE CASE WHEN best - base < 0.02 THEN l_returnflag = 'A' ELSE score + 0.01 >= best END ORDER BY l_returnflag LIMIT 1""",
    "angle_retention": """WITH g AS (SELECT event_type, event_id % 4 * 90 AS angle, round(avg(value), 6) AS score FROM events GROUP BY 1, 2) SELECT event_type, angle, score, round(score / nullif((SELECT max(score) FROM g b WHERE b.event_type = g.event_type AND angle = 0), 0), 6) AS retention FROM g""",
}
