"""Queries that check, filter, redact and score rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import sqlnames as S
from folioflow.functions.names import plain_name
from folioflow.operators import validation as V
from folioflow.sources import inventory as I
from folioflow.sources.lines import DOCUMENT_SQL, document_lines
from folioflow.sources.tables import current_rows, table


def report_violations(spark, d):
    """Rules that the end-to-end reports don't keep."""
    r = current_rows(table(spark, d, "locked_test_end_to_end_metrics").select("report_id", "recorded_at", "ingested_at", "build_id", "split", "sample_count", "failure_count", "duration_seconds", "status"), "report_id", ["build_id", "split", "sample_count", "failure_count", "duration_seconds", "status"])
    c = F.col
    rules = {"build_id": F.trim("build_id") != "", "split": c("split").isin("test_in_domain", "dev_select", "dev_calibration"), "failure_count": c("failure_count").between(0, c("sample_count")), "duration_seconds": c("duration_seconds") >= 0, "status": F.lower(F.trim("status")).isin("complete", "partial", "rerun")}
    return r.select("report_id", F.array_join(V.violations(rules), ",").alias("broken")).where("broken <> ''")


def page_quality(spark, d):
    q = V.quality_signals(document_lines(spark, d), "doc_id")
    return q.select("doc_id", "box_count", F.round("height_ratio", 9).alias("height_ratio"), F.round("coverage", 9).alias("coverage"), F.round("mean_confidence", 9).alias("mean_confidence"), "characters", F.array_join(V.rerender_reasons(), ",").alias("reasons"), F.array_join(V.tiling_reasons(F.lit(1400)), ",").alias("tiling"))


def ocr_score(spark, d):
    s = V.candidate_score(document_lines(spark, d), "doc_id")
    return s.select("doc_id", *[F.round(c, 6).alias(c) for c in s.columns[1:]])


def text_strata(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    s = docs.select("doc_id", *[v.alias(k) for k, v in V.text_strata(F.col("text")).items()], V.bucket(F.length("text"), 400, 1200).alias("length_bucket"))
    return s.groupBy("has_amount", "has_date", "has_identifier", "has_thai", "critical_expected", "length_bucket").agg(F.count(F.lit(1)).alias("documents"))


def redact_text(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(V.redact(F.col("text"), ["mail.example", "desk"], None).cast("binary")).alias("digest"))


def orphan_pages(spark, d):
    """Pages whose source file no run recorded."""
    pages = current_rows(table(spark, d, "validation").select("page_id", "source_file_id", "recorded_at", "ingested_at"), "page_id", ["source_file_id"]).where("source_file_id IS NOT NULL")
    return V.foreign_keys(pages, ["source_file_id"], table(spark, d, "raw_baseline"), ["file_id"]).select("page_id", "source_file_id")


def profile_values(spark, d):
    r = table(spark, d, "locked_test_end_to_end_metrics").select("schema_version", "split", F.lit(1).alias("build"))
    return V.single_profile(r, ["schema_version", "split", "build"])


def path_facts(spark, d):
    """What a file's path tells: component, split, key, family, category, privacy."""
    f = table(spark, d, "raw_baseline").select("safe_path", plain_name(F.col("dataset")).alias("dataset"), "file_id").distinct()
    p, ds = F.col("safe_path"), F.col("dataset")
    return f.select("file_id", "safe_path", I.component(ds, p).alias("component"), I.original_split(ds, p).alias("original_split"), I.document_key(ds, p).alias("document_key"), I.template_family(ds, I.stem(p)).alias("family"), I.category(ds, p, I.extension(p)).alias("category"), I.is_private(p).alias("path_private"), I.safe_path(p, F.col("file_id")).alias("report_path"))


def family_roles(spark, d):
    r = table(spark, d, "raw_baseline").select(F.try_element_at(F.split(I.slashes(F.col("safe_path")), "/"), F.lit(-2)).alias("family"), plain_name(F.col("dataset")).alias("role"))
    return V.family_roles(r, "family", "role")


def latest_records(spark, d):
    r = table(spark, d, "raw_baseline").select("file_id", "baseline_run", "size_bytes", F.struct("recorded_at", "size_bytes").alias("at"))
    return V.latest(r, ["file_id", "baseline_run"], "at").select("file_id", "baseline_run", "size_bytes")


def rotation_schedule(spark, d):
    pages = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    s = V.schedule(pages, "o_orderstatus", {"F": [0, 90, 180, 270], "O": [0], "P": [0, 45]})
    return s.groupBy("o_orderstatus", "angle").agg(F.count(F.lit(1)).alias("n"))


def dictionary_audit(spark, d):
    """Characters of the documents that the eval items never use, most frequent first."""
    chars = lambda t: table(spark, d, t).select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    known = chars("eval_items").distinct()
    return chars("documents").groupBy("ch").agg(F.count(F.lit(1)).alias("n")).join(known, "ch", "left_anti").select(F.hex(F.encode("ch", "utf-8")).alias("code"), "n").orderBy(F.desc("n"), "code").limit(50)


def selected_models(spark, d):
    """Models of the registries by role and variant, with mean development F1."""
    raw = table(spark, d, "model_registry")
    r = raw.groupBy("registry_id").agg(F.max_by("models", F.struct("recorded_at", "ingested_at")).alias("m")).select("registry_id", F.explode("m").alias("name", "v")).where("v IS NOT NULL")
    return r.groupBy(F.col("v.role").alias("role"), F.col("v.variant").alias("variant")).agg(F.count(F.lit(1)).alias("models"), F.count_if(F.col("v.selected")).alias("selected"), F.round(F.avg("v.development_metrics.f1"), 9).alias("mean_f1"))


def error_totals(spark, d):
    """Error counts of all end-to-end reports by kind, with the share of reports that name it."""
    raw = table(spark, d, "locked_test_end_to_end_metrics")
    r = raw.groupBy("report_id").agg(F.max_by("error_counts", F.struct("recorded_at", "ingested_at")).alias("m"))
    e = r.select("report_id", F.explode("m").alias("error", "n")).where("n IS NOT NULL")
    return e.groupBy("error").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("reports"))


def event_windows(spark, d):
    """Tumbling day windows per event type."""
    e = table(spark, d, "events")
    return e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {f.__name__: f for f in (
    report_violations, page_quality, ocr_score, text_strata, redact_text, orphan_pages, profile_values, path_facts, family_roles, latest_records, rotation_schedule, dictionary_audit, selected_models, error_totals, event_windows,
)}
_E2E = "(SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY recorded_at DESC, ingested_at DESC) AS i FROM locked_test_end_to_end_metrics)"
_CRIT = " OR ".join(f"contains(lower(text), '{w}')" for w in V.CRITICAL)
ORACLES = {
    "report_violations": f"""SELECT report_id, concat_ws(',', CASE WHEN coalesce(trim(build_id), '') = '' THEN 'build_id' END, CASE WHEN coalesce(split IN ('test_in_domain', 'dev_select', 'dev_calibration'), false) THEN NULL ELSE 'split' END, CASE WHEN coalesce(failure_count BETWEEN 0 AND sample_count, false) THEN NULL ELSE 'failure_count' END,
        CASE WHEN coalesce(duration_seconds >= 0, false) THEN NULL ELSE 'duration_seconds' END, CASE WHEN coalesce(lower(trim(status)) IN ('complete', 'partial', 'rerun'), false) THEN NULL ELSE 'status' END) AS broken FROM {_E2E} WHERE i = 1 AND broken <> ''""",
    "page_quality": rf"""WITH {DOCUMENT_SQL}, q AS (SELECT doc_id, count(*) AS box_count, median(y1 - y0) / 1400.0 AS hr, least(1.0, sum(x1 * (y1 - y0)) / 1400000.0) AS cov, avg(confidence) AS mc, median(confidence) AS md, sum(length(regexp_replace(text, '[\t\n\x0b\f\r ]+', '', 'g')))::BIGINT AS characters, bool_or({_CRIT}) AS crit FROM lines GROUP BY 1)
        SELECT doc_id, box_count, round(hr, 9) AS height_ratio, round(cov, 9) AS coverage, round(mc, 9) AS mean_confidence, characters,
        concat_ws(',', CASE WHEN hr < 0.008 THEN 'tiny_median_text_height' END, CASE WHEN box_count < 3 THEN 'suspiciously_few_text_boxes' END, CASE WHEN cov < 0.0015 THEN 'low_text_coverage' END, CASE WHEN mc < 0.5 OR md < 0.5 THEN 'low_recognition_confidence' END, CASE WHEN characters < 20 THEN 'unusually_short_ocr_text' END, CASE WHEN NOT crit THEN 'critical_text_missing' END) AS reasons,
        concat_ws(',', CASE WHEN box_count < 3 THEN 'weak_full_page_box_count' END, CASE WHEN cov < 0.0015 THEN 'weak_full_page_coverage' END, CASE WHEN hr < 0.007 THEN 'small_text' END, CASE WHEN mc < 0.5 THEN 'low_full_page_confidence' END) AS tiling FROM q""",
    "redact_text": "SELECT doc_id, md5(replace(replace(text, 'mail.example', '<private>'), 'desk', '<private>')) AS digest FROM documents WHERE text IS NOT NULL",
    "orphan_pages": f"SELECT page_id, source_file_id FROM {S.current('validation', 'page_id')} WHERE source_file_id IS NOT NULL AND source_file_id NOT IN (SELECT file_id FROM raw_baseline)",
    "profile_values": "SELECT * FROM (SELECT 'schema_version' AS column, count(DISTINCT schema_version) AS values FROM locked_test_end_to_end_metrics UNION ALL SELECT 'split', count(DISTINCT split) FROM locked_test_end_to_end_metrics) t(\"column\", \"values\") WHERE \"values\" <> 1",
    "path_facts": rf"""WITH f AS (SELECT DISTINCT safe_path, {S.plain('dataset')} AS dataset, file_id FROM raw_baseline), p AS (SELECT *, string_split(replace(safe_path, chr(92), '/'), '/') AS parts, regexp_extract(replace(safe_path, chr(92), '/'), '([^/]+)\.[^./]*$', 1) AS stem, lower(regexp_extract(safe_path, '(\.[^./]+)$', 1)) AS ext FROM f)
        SELECT file_id, safe_path, coalesce(parts[2], dataset) AS component, CASE WHEN list_contains(parts, 'train') THEN 'train' WHEN list_contains(parts, 'validation') OR list_contains(parts, 'val') THEN 'validation' WHEN list_contains(parts, 'test') THEN 'test' WHEN list_contains(parts, 'dev') THEN 'validation' ELSE 'unspecified' END AS original_split,
        CASE WHEN dataset = 'coru' THEN parts[1] || '/' || stem ELSE stem END AS document_key, CASE WHEN dataset = 'fatura' THEN 'unknown' ELSE '' END AS family, CASE dataset WHEN 'sroie' THEN 'receipt' WHEN 'funsd' THEN 'form' WHEN 'fatura' THEN 'invoice' WHEN 'coru' THEN 'receipt' ELSE 'unknown' END AS category,
        lower(safe_path) LIKE '%private%' OR lower(safe_path) LIKE '%gmail%' AS path_private, CASE WHEN lower(safe_path) LIKE '%private%' OR lower(safe_path) LIKE '%gmail%' THEN regexp_replace(safe_path, '[^/]*$', '') || file_id || ext ELSE safe_path END AS report_path FROM p""",
    "family_roles": f"SELECT string_split(replace(safe_path, chr(92), '/'), '/')[-2] AS family, count(DISTINCT {S.plain('dataset')}) AS roles FROM raw_baseline GROUP BY 1 HAVING family IS NOT NULL AND count(DISTINCT {S.plain('dataset')}) > 1",
    "latest_records": "SELECT file_id, baseline_run, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY file_id, baseline_run ORDER BY recorded_at DESC, size_bytes DESC NULLS LAST) AS i FROM raw_baseline) WHERE i = 1",
    "rotation_schedule": "SELECT o_orderstatus, a::DOUBLE AS angle, count(*) AS n FROM orders JOIN (VALUES ('F', 0), ('F', 90), ('F', 180), ('F', 270), ('O', 0), ('P', 0), ('P', 45)) k(s, a) ON s = o_orderstatus GROUP BY 1, 2",
    "selected_models": """WITH r AS (SELECT models FROM (SELECT *, row_number() OVER (PARTITION BY registry_id ORDER BY recorded_at DESC, ingested_at DESC) AS i FROM model_registry) WHERE i = 1), m AS (SELECT unnest(map_values(models)) AS v FROM r)
        SELECT v.role AS role, v.variant AS variant, count(*) AS models, count(*) FILTER (v.selected) AS selected, round(avg(v.development_metrics.f1), 9) AS mean_f1 FROM m WHERE v IS NOT NULL GROUP BY 1, 2""",
    "error_totals": f"""WITH r AS (SELECT report_id, error_counts FROM {_E2E} WHERE i = 1), e AS (SELECT report_id, unnest(map_keys(error_counts)) AS error, unnest(map_values(error_counts)) AS n FROM r) SELECT error, sum(n)::BIGINT AS total, count(*) AS reports FROM e WHERE n IS NOT NULL GROUP BY 1""",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
