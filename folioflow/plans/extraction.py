"""Queries over rendered invoices and document lines: fields, entities, relations, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.functions import text as X
from folioflow.operators import extract as E
from folioflow.sources.lines import DOCUMENT_SQL, INVOICE_SQL, document_lines, invoice_lines
from folioflow.sources.tables import table

BY = ["doc_id"]


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    lines = invoice_lines(spark, d)
    rules = E.rule_candidates(lines).select("doc_id", "line_no", "field", "value", "raw_text", "field_confidence")
    return rules.unionByName(E.header_organization(lines, BY))


def rule_fields_best(spark: SparkSession, d: str) -> DataFrame:
    return E.best_fields(_candidates(spark, d), BY).drop("conflict")


def rule_field_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return E.best_fields(_candidates(spark, d), BY).where("conflict").select("doc_id", "field")


def total_consistency(spark: SparkSession, d: str) -> DataFrame:
    return E.total_consistency(E.best_fields(_candidates(spark, d), BY), BY).select("doc_id", "subtotal", "discount", "tax", "total_amount", "total_status", "total_below_subtotal", "balance_status")


def kv_entities(spark: SparkSession, d: str) -> DataFrame:
    return E.key_values(invoice_lines(spark, d))


def kv_relations(spark: SparkSession, d: str) -> DataFrame:
    return E.best_relations(E.relation_candidates(E.key_values(invoice_lines(spark, d))))


def document_languages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where("text IS NOT NULL").select("doc_id", F.array_join(E.detected_languages(F.col("text")), ",").alias("languages"), X.contains_thai(F.col("text")).alias("has_thai"), F.length(X.turkish_letters(F.col("text"))).alias("turkish_letters"))


def document_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of the documents give evidence for each field."""
    return E.rule_candidates(document_lines(spark, d).select("doc_id", "line_no", "text", "confidence")).groupBy("field").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("doc_id").alias("documents"))


def bio_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal event types of a user."""
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type")
    r = E.runs(e, ["user_id"], "at", "event_type")
    return r.select("user_id", "run_no", "run_value", F.col("first_at.event_id").alias("first_event"), F.col("last_at.event_id").alias("last_event"), "run_length")


def bio_tags(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "view", "OTHER").otherwise(F.col("event_type")).alias("label"), F.to_date("ts").alias("entity"))
    return E.bio_tags(e, ["user_id"], "at", "label", "entity").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def _two_sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Per user and event type: the value of the first and of the last event, with confidences."""
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    text, conf = F.round("value", 0).cast("bigint").cast("string"), (F.col("event_id") % 97) / F.lit(97.0)
    side = lambda pick: e.groupBy("user_id", "event_type").agg(pick(F.struct(text.alias("value"), conf.alias("confidence")), "at").alias("s")).select("user_id", "event_type", "s.*")
    return side(F.min_by).where("event_type <> 'click'"), side(F.max_by).where("event_type <> 'view'")


def field_fusion(spark: SparkSession, d: str) -> DataFrame:
    left, right = _two_sources(spark, d)
    return E.fuse_pages(left, right, ["user_id", "event_type"])


def document_fusion(spark: SparkSession, d: str) -> DataFrame:
    left, right = _two_sources(spark, d)
    return E.fuse_document(left.unionByName(right), ["user_id"]).select("user_id", "value", F.round("score", 9).alias("score"), "n", "abstained")


def doc_type_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", ((F.col("event_id") % 97) / F.lit(97.0)).alias("confidence"))
    return E.fuse_types(e, ["user_id"], "event_type", "confidence").select("user_id", "document_type", F.round("confidence", 9).alias("confidence"))


def money_normalize(spark: SparkSession, d: str) -> DataFrame:
    """The last amount of every document line, by both readings of the comma."""
    lines = document_lines(spark, d).select("doc_id", "line_no", X.last_money(F.col("text")).alias("raw")).where("raw IS NOT NULL")
    return lines.select("doc_id", "line_no", "raw", X.money(F.col("raw")).cast("double").alias("rule_amount"), X.loose_number(F.col("raw")).try_cast("double").alias("loose_amount"), X.decimal_mark(F.col("raw")).alias("mark"))


def date_normalize(spark: SparkSession, d: str) -> DataFrame:
    hit = X.found(F.col("text"), r"\b\d{1,4}[./\-]\d{1,2}[./\-]\d{1,4}\b")
    return document_lines(spark, d).select("doc_id", "line_no", hit.alias("raw")).where("raw IS NOT NULL").select("doc_id", "line_no", "raw", X.iso_date(F.col("raw")).alias("iso"))


def table_like_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least two rows of two or more cells parted by '|'."""
    cells = document_lines(spark, d).select("doc_id", "line_no", F.size(F.filter(F.split("text", r"\|"), lambda c: F.trim(c) != "")).alias("cells"))
    return cells.where("cells >= 2").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("cells").alias("columns")).where("rows >= 2")


_CAND = rf"""{INVOICE_SQL}, up AS (SELECT *, lower(text) AS low FROM lines),
  cand AS (
    SELECT doc_id, line_no, 'date' AS field, regexp_extract(text, '\b\d{{1,4}}[./\-]\d{{1,2}}[./\-]\d{{1,4}}\b') AS value, regexp_extract(text, '\b\d{{1,4}}[./\-]\d{{1,2}}[./\-]\d{{1,4}}\b') AS raw_text, confidence FROM up
    UNION ALL SELECT doc_id, line_no, 'phone_number', regexp_replace(regexp_extract(text, '(?:^|\W)(\+?\d[\d\s().\-]{{6,}}\d)(?:$|\W)', 1), '[^+\d]', '', 'g'), regexp_extract(text, '(?:^|\W)(\+?\d[\d\s().\-]{{6,}}\d)(?:$|\W)', 1), confidence FROM up
    UNION ALL SELECT doc_id, line_no, 'invoice_number', regexp_extract(text, '[:#]\s*([A-Za-z0-9][A-Za-z0-9/_.\-]{{2,}})', 1), regexp_extract(text, '[:#]\s*([A-Za-z0-9][A-Za-z0-9/_.\-]{{2,}})'), confidence FROM up WHERE low LIKE '%invoice no%'
    UNION ALL SELECT doc_id, line_no, f, CASE WHEN line_no BETWEEN 3 AND 6 THEN regexp_extract(text, '([-+]?\d[\d.,]*\d)', 1) END, regexp_extract(text, '([-+]?\d[\d.,]*\d(?:\s*USD)?)', 1), CASE WHEN f = 'total_amount' THEN confidence ELSE least(1.0, confidence + 0.06) END
      FROM up JOIN (VALUES (3, 'subtotal'), (4, 'discount'), (5, 'tax'), (6, 'total_amount')) k(n, f) ON n = line_no
    UNION ALL SELECT doc_id, line_no, 'customer_name', trim(regexp_extract(text, ':(.*)$', 1)), text, confidence FROM up WHERE line_no = 7
    UNION ALL SELECT doc_id, line_no, 'currency', 'USD', text, confidence FROM up WHERE low LIKE '%usd%'
    UNION ALL SELECT doc_id, line_no, 'document_title', 'invoice', text, confidence FROM up WHERE low LIKE '%invoice%'
    UNION ALL SELECT doc_id, line_no, 'organization_name', text, text, confidence * 0.75 FROM up WHERE line_no = 0),
  best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY confidence DESC, line_no) AS r, count(*) OVER (PARTITION BY doc_id, field) AS n, min(value) OVER (PARTITION BY doc_id, field) <> max(value) OVER (PARTITION BY doc_id, field) AS conflict
    FROM cand WHERE value <> '')"""
_KV = rf"""{INVOICE_SQL}, p AS (SELECT *, trim(regexp_extract(text, '^([^:]*):', 1)) AS k, trim(regexp_extract(text, '^[^:]*:(.*)$', 1)) AS v, (8 * length(text))::DOUBLE AS x1, (20 * line_no)::DOUBLE AS y0, (20 * line_no + 16)::DOUBLE AS y1 FROM lines),
  q AS (SELECT *, x1 * least(0.8, greatest(0.2, length(k) / greatest(length(text), 1))) AS cut, least(1.0, confidence * 0.8) AS c FROM p WHERE k <> '' AND v <> ''),
  ent AS (SELECT doc_id, 1 AS page_number, line_no, 'generic_entity_' || substr(sha256('1|' || line_no || '|KEY|' || k), 1, 16) AS entity_id, 'KEY' AS label, k AS entity_text, 0.0::DOUBLE AS ex0, y0 AS ey0, cut AS ex1, y1 AS ey1, c AS entity_confidence FROM q
    UNION ALL SELECT doc_id, 1, line_no, 'generic_entity_' || substr(sha256('1|' || line_no || '|VALUE|' || v), 1, 16), 'VALUE', v, cut, y0, x1, y1, c FROM q)"""
_SIDES = """e AS (SELECT user_id, event_type, CAST(CAST(round(value, 0) AS BIGINT) AS VARCHAR) AS value, (event_id % 97) / 97.0::DOUBLE AS confidence, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS b FROM events),
  l AS (SELECT user_id, event_type, value, confidence FROM e WHERE a = 1 AND event_type <> 'click'), r AS (SELECT user_id, event_type, value, confidence FROM e WHERE b = 1 AND event_type <> 'view')"""
QUERIES = {
    "rule_fields_best": rule_fields_best, "rule_field_conflicts": rule_field_conflicts, "total_consistency": total_consistency, "kv_entities": kv_entities, "kv_relations": kv_relations,
    "document_languages": document_languages, "document_rule_counts": document_rule_counts, "bio_runs": bio_runs, "bio_tags": bio_tags, "field_fusion": field_fusion, "document_fusion": document_fusion,
    "doc_type_merge": doc_type_merge, "money_normalize": money_normalize, "date_normalize": date_normalize, "table_like_pages": table_like_pages,
}
ORACLES = {
    "rule_fields_best": f"WITH {_CAND} SELECT doc_id, field, value, raw_text, confidence, line_no FROM best WHERE r = 1",
    "rule_field_conflicts": f"WITH {_CAND} SELECT DISTINCT doc_id, field FROM best WHERE conflict",
    "total_consistency": f"""WITH {_CAND}, w AS (SELECT doc_id, max(CASE WHEN field = 'subtotal' THEN value::DECIMAL(20,2) END) AS subtotal, max(CASE WHEN field = 'discount' THEN value::DECIMAL(20,2) END) AS discount,
        max(CASE WHEN field = 'tax' THEN value::DECIMAL(20,2) END) AS tax, max(CASE WHEN field = 'total_amount' THEN value::DECIMAL(20,2) END) AS total_amount FROM best WHERE r = 1 AND field IN ('subtotal', 'discount', 'tax', 'total_amount') GROUP BY 1)
        SELECT *, CASE WHEN abs(subtotal + tax - discount - total_amount) > greatest(0.05::DECIMAL(20,4), (abs(total_amount) * 0.02::DECIMAL(4,2))::DECIMAL(20,4)) THEN 'conflict' ELSE 'validated' END AS total_status,
        total_amount < subtotal AS total_below_subtotal, 'not_checked' AS balance_status FROM w""",
    "kv_entities": f"WITH {_KV} SELECT * FROM ent",
    "kv_relations": f"""WITH {_KV}, ext AS (SELECT doc_id, max(greatest(ex1, ey1)) AS extent FROM ent GROUP BY 1),
        c AS (SELECT s.doc_id, s.page_number, s.entity_id AS source_id, t.entity_id AS target_id, sqrt(((t.ex0 + t.ex1) / 2 - (s.ex0 + s.ex1) / 2) ** 2 + ((t.ey0 + t.ey1) / 2 - (s.ey0 + s.ey1) / 2) ** 2) / greatest(1.0, extent) AS nd,
          (t.ex0 + t.ex1) / 2 >= (s.ex0 + s.ex1) / 2 AS isr, (t.ey0 + t.ey1) / 2 >= (s.ey0 + s.ey1) / 2 AS isb, greatest(s.ey0, t.ey0) <= least(s.ey1, t.ey1) AS sl,
          greatest(0, t.ey0 - s.ey1, s.ey0 - t.ey1) AS vg, greatest(0, t.ex0 - s.ex1, s.ex0 - t.ex1) AS hg FROM ent s JOIN ent t ON s.doc_id = t.doc_id AND s.label = 'KEY' AND t.label = 'VALUE' JOIN ext ON ext.doc_id = s.doc_id),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source_id ORDER BY nd + CASE WHEN NOT isr AND NOT isb THEN 0.25 ELSE 0 END - CASE WHEN sl THEN 0.15 ELSE 0 END, vg, hg, target_id) AS r FROM c WHERE nd <= 0.6)
        SELECT doc_id, page_number, source_id, target_id, 'KEY_VALUE' AS relation_type, greatest(0.0, least(1.0, 1.0 - nd)) AS confidence FROM b WHERE r = 1""",
    "document_languages": r"""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '[\x{0E00}-\x{0E7F}]') THEN 'th' END, CASE WHEN regexp_matches(text, '[çğıöşüÇĞİÖŞÜ]') THEN 'tr' END,
        CASE WHEN NOT regexp_matches(text, '[\x{0E00}-\x{0E7F}]') AND NOT regexp_matches(text, '[çğıöşüÇĞİÖŞÜ]') THEN 'en' END) AS languages, regexp_matches(text, '[\x{0E00}-\x{0E7F}]') AS has_thai,
        length(regexp_replace(text, '[^çğıöşüÇĞİÖŞÜ]', '', 'g')) AS turkish_letters FROM documents WHERE text IS NOT NULL""",
    "bio_runs": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
        b AS (SELECT *, sum(CASE WHEN i > 1 AND p IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS run_no FROM a)
        SELECT user_id, run_no, min(event_type) AS run_value, arg_min(event_id, i) AS first_event, arg_max(event_id, i) AS last_event, count(*) AS run_length FROM b GROUP BY 1, 2""",
    "bio_tags": """WITH a AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'view' THEN 'OTHER' ELSE event_type END AS label, CAST(ts AS DATE) AS day FROM events),
        b AS (SELECT *, lag(label) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pl, lag(day) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pd FROM a)
        SELECT CASE WHEN label = 'OTHER' THEN 'O' WHEN pl = label AND pd = day THEN 'I-' || label ELSE 'B-' || label END AS tag, count(*) AS n FROM b GROUP BY 1""",
    "field_fusion": f"""WITH {_SIDES}, j AS (SELECT coalesce(l.user_id, r.user_id) AS user_id, coalesce(l.event_type, r.event_type) AS event_type, l.value AS lv, r.value AS rv, l.confidence AS lc, r.confidence AS rc FROM l FULL JOIN r ON l.user_id = r.user_id AND l.event_type = r.event_type),
        k AS (SELECT *, CASE WHEN lv IS NULL THEN 'right_only' WHEN rv IS NULL THEN 'left_only' WHEN lv = rv THEN 'agree' WHEN lc - rc >= 0.15 THEN 'left_wins' WHEN rc - lc >= 0.15 THEN 'right_wins' ELSE 'abstain' END AS decision FROM j)
        SELECT user_id, event_type, decision, CASE WHEN decision = 'abstain' THEN NULL WHEN decision IN ('left_only', 'left_wins') OR (decision = 'agree' AND lc >= rc) THEN lv ELSE rv END AS value,
        CASE WHEN decision = 'abstain' THEN NULL WHEN decision IN ('left_only', 'left_wins') OR (decision = 'agree' AND lc >= rc) THEN lc ELSE rc END AS confidence FROM k""",
    "document_fusion": f"""WITH {_SIDES}, a AS (SELECT * FROM l UNION ALL SELECT * FROM r), g AS (SELECT user_id, value, max(confidence) + least(0.10, 0.03 * (count(*) - 1)) AS score, count(*) AS n FROM a GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, value) AS i, lead(score) OVER (PARTITION BY user_id ORDER BY score DESC, value) AS nx FROM g)
        SELECT user_id, CASE WHEN coalesce(score - nx < 0.10, false) THEN NULL ELSE value END AS value, round(score, 9) AS score, n, coalesce(score - nx < 0.10, false) AS abstained FROM k WHERE i = 1""",
    "doc_type_merge": """WITH g AS (SELECT user_id, event_type, avg((event_id % 97) / 97.0::DOUBLE) AS m FROM events GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, event_type) AS i, lead(m) OVER (PARTITION BY user_id ORDER BY m DESC, event_type) AS nx FROM g)
        SELECT user_id, CASE WHEN coalesce(m - nx < 0.10, false) THEN 'unknown' ELSE event_type END AS document_type, CASE WHEN coalesce(m - nx < 0.10, false) THEN NULL ELSE round(m, 9) END AS confidence FROM k WHERE i = 1""",
    "table_like_pages": rf"""WITH {DOCUMENT_SQL}, c AS (SELECT doc_id, line_no, len(list_filter(string_split(text, '|'), lambda x: trim(x) <> '')) AS cells FROM lines)
        SELECT doc_id, count(*) AS rows, max(cells) AS columns FROM c WHERE cells >= 2 GROUP BY 1 HAVING count(*) >= 2""",
}
