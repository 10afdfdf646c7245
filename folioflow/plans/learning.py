"""Queries of supervision, decoding, recognition and noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from folioflow.functions import noise as N
from folioflow.operators import learning as L, recognition as R
from folioflow.sources.lines import document_lines, invoice_lines
from folioflow.sources.tables import table


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as tokens with tags: their kinds, some of them O."""
    kind = F.col("event_type")
    tag = F.when(F.col("event_id") % 5 == 0, "O").when(F.col("event_id") % 3 == 0, F.concat(F.lit("B-"), kind)).otherwise(F.concat(F.lit("I-"), kind))
    x = (F.col("event_id") % 100).cast("double")
    return table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"), tag.alias("tag"), F.col("event_id").cast("string").alias("text"), x.alias("x0"), x.alias("y0"), (x + 10).alias("x1"), (x + 5).alias("y1"), (F.col("event_id") % 97 / F.lit(97.0)).alias("confidence"))


def token_spans(spark, d):
    s = L.token_spans(_tagged(spark, d), ["user_id"], "at", "tag")
    return s.select("user_id", "span_no", "label", F.col("first_at.event_id").alias("first_event"), F.col("last_at.event_id").alias("last_event"), "x0", "x1", F.round("confidence", 9).alias("confidence"))


def field_decoding(spark, d):
    """Each event as a probability vector over no field and three fields."""
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.col("event_id").cast("string").alias("text"), F.array(*[(F.col("event_id") * m % 101 / F.lit(101.0)) for m in (3, 5, 7, 11)]).alias("v"))
    f = L.decode_fields(e, ["user_id"], "at", "v", ["NONE", "date", "total", "currency"], {"total": 0.9}, 0.6)
    return f.select("user_id", "field", "value", F.round("confidence", 9).alias("confidence"))


def type_decoding(spark, d):
    v = F.array(*[(F.col("event_id") * m % 101 / F.lit(101.0)) for m in (3, 5, 7)])
    e = table(spark, d, "events").select(L.decode_type(v, ["invoice", "receipt", "other"], 0.6).alias("document_type"))
    return e.groupBy("document_type").agg(F.count(F.lit(1)).alias("n"))


def hard_negatives(spark, d):
    """Items of an order as entities; the item of largest price is related to every other one."""
    i = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.when(F.col("l_linenumber") % 2 == 0, "KEY").otherwise("VALUE").alias("label"), F.col("l_quantity").alias("q"))
    a, b = i.alias("a"), i.alias("b")
    pairs = a.join(b, "l_orderkey").select("l_orderkey", F.col("a.n").alias("source_id"), F.col("b.n").alias("target_id"), F.col("a.label").alias("source_label"), F.col("b.label").alias("target_label"), F.abs(F.col("a.q") - F.col("b.q")).alias("distance"))
    positives = pairs.where("source_id = 1 AND target_id > 1").select("l_orderkey", "source_id", "target_id", F.lit("KEY_VALUE").alias("type"))
    return L.relation_supervision(pairs, positives, "l_orderkey", 1)


def sequence_windows(spark, d):
    s = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", " ").alias("w"))
    return L.windows(s, "doc_id", "w", 64, 16).select("doc_id", "window_no", "start", F.size("items").alias("n"))


def recognition_report(spark, d):
    """Neighbouring invoice lines as reference and prediction, by kind of line."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    l = invoice_lines(spark, d).select("doc_id", F.col("text").alias("ref"), F.lead("text").over(w).alias("pred"), F.greatest("confidence", F.lead("confidence").over(w)).alias("confidence"), F.lead("line_no").over(w).alias("next")).where("next IS NOT NULL")
    s = R.samples(l.withColumn("kind", F.when(F.col("doc_id") % 2 == 0, "date").otherwise("amount")), "ref", "pred", "kind")
    c = R.corpus(s, ["kind"], "confidence")
    return c.select("kind", "samples", "characters", "errors", F.round("cer", 9).alias("cer"), "exact", "numeric_exact", F.round("brier", 9).alias("brier"))


def critical_fields(spark, d):
    """Order totals as references, rounded totals as predictions; names against their upper case."""
    o = table(spark, d, "orders").select("o_orderkey", F.array(F.struct(F.lit("total_amount").alias("field"), F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("r"), F.round("o_totalprice", 0).cast("decimal(20,2)").cast("string").alias("p")), F.struct(F.lit("date").alias("field"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("r"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("p")), F.struct(F.lit("invoice_number").alias("field"), F.concat(F.lit("INV-"), "o_orderkey").alias("r"), F.concat(F.lit("inv"), "o_orderkey").alias("p"))).alias("f"))
    p = o.select("o_orderkey", F.explode("f").alias("f")).select("o_orderkey", "f.*")
    s = R.field_summary(R.field_metrics(p, "field", "r", "p"), ["field"])
    return s.select("field", "evaluated", F.round("exact", 9).alias("exact"), F.round("within_tolerance", 9).alias("within_tolerance"), "same_mark")


def token_noise(spark, d):
    """What each disturbance makes of the part names."""
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("-", "p_name", F.col("p_retailprice").cast("decimal(12,2)").cast("string")).alias("t"))
    return p.select("p_partkey", N.confuse(F.col("t")).alias("confused"), N.drop_mark(F.col("t")).alias("unmarked"), N.respace(F.col("p_partkey").cast("string")).alias("respaced"), N.swap_decimal(F.col("t")).alias("swapped"))


def noisy_examples(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", r"\s+").alias("w"))
    return docs.select("doc_id", N.noisy(F.col("doc_id"), F.col("w")).alias("n"), "w").where("n IS NOT NULL").select("doc_id", F.size(F.filter(F.zip_with("n", "w", lambda a, b: ~a.eqNullSafe(b)), lambda x: x)).alias("disturbed"))


def page_deskew(spark, d):
    """Lines as words of pages turned a little by their number."""
    turn = F.radians((F.col("doc_id") % 7 - 3).cast("double"))
    x, y = F.col("x1"), F.col("y0")
    w = document_lines(spark, d).select("doc_id", "confidence", F.array(F.lit(0.0), y).alias("p0"), F.array(x * F.cos(turn), y + x * F.sin(turn)).alias("p1"), F.array(x * F.cos(turn), y + x * F.sin(turn) + 16).alias("p2"), F.array(F.lit(0.0), y + 16).alias("p3"))
    k = L.deskew(w, "doc_id")
    return k.select("doc_id", F.round("text_angle", 6).alias("text_angle"), F.round("dispersion", 6).alias("dispersion"), "supported")


def dataset_build_id(spark, d):
    return L.build_id(table(spark, d, "raw_baseline").select("file_id", "sha256").distinct(), ["file_id", "sha256"], "final|1")


def orientation_facts(spark, d):
    v = F.round("value", 3)
    e = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(v)).alias("v"), R.confusable_orientation(v).alias("mixed"))
    return e.select("user_id", F.round(R.top_gap(F.col("v")), 6).alias("gap"), R.nearest_cardinal(F.try_element_at("v", F.lit(1))).alias("cardinal"), "mixed")


QUERIES = {f.__name__: f for f in (token_spans, field_decoding, type_decoding, hard_negatives, sequence_windows, recognition_report, critical_fields, token_noise, noisy_examples, page_deskew, dataset_build_id, orientation_facts)}
_V = "(event_id * {} % 101) / 101.0::DOUBLE"
ORACLES = {
    "token_spans": """WITH t AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS label, event_id % 5 > 0 AND event_id % 3 = 0 AS b, event_id % 100 AS x, (event_id % 97) / 97.0::DOUBLE AS c FROM events),
        l AS (SELECT *, row_number() OVER w AS i, coalesce(lag(label) OVER w, '') AS p FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(CASE WHEN label <> '' AND (b OR p <> label) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS span_no FROM l)
        SELECT user_id, span_no, min(label) AS label, arg_min(event_id, i) AS first_event, arg_max(event_id, i) AS last_event, min(x)::DOUBLE AS x0, max(x)::DOUBLE + 10 AS x1, round(avg(c), 9) AS confidence FROM s WHERE label <> '' GROUP BY 1, 2""",
    "type_decoding": f"""WITH v AS (SELECT {_V.format(3)} AS a, {_V.format(5)} AS b, {_V.format(7)} AS c FROM events), k AS (SELECT greatest(a, b, c) AS m, CASE WHEN a >= b AND a >= c THEN 'invoice' WHEN b >= c THEN 'receipt' ELSE 'other' END AS n FROM v)
        SELECT CASE WHEN m < 0.6 OR n = 'other' THEN 'unknown' ELSE n END AS document_type, count(*) AS n FROM k GROUP BY 1""",
    "hard_negatives": """WITH i AS (SELECT l_orderkey, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 0 THEN 'KEY' ELSE 'VALUE' END AS label, l_quantity AS q FROM lineitem), p AS (SELECT a.l_orderkey, a.n AS source_id, b.n AS target_id, CASE WHEN a.label = 'KEY' AND b.label = 'VALUE' THEN 0 ELSE 1 END AS bad, abs(a.q - b.q) AS d FROM i a JOIN i b USING (l_orderkey)),
        c AS (SELECT l_orderkey, count(*) AS k FROM (SELECT DISTINCT l_orderkey, target_id FROM p WHERE source_id = 1 AND target_id > 1) GROUP BY 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY bad, d, sha256('42|' || l_orderkey || '|' || source_id || '|' || target_id)) AS r FROM p LEFT JOIN c USING (l_orderkey) WHERE source_id <> target_id AND NOT (source_id = 1 AND target_id > 1))
        SELECT DISTINCT l_orderkey, source_id, target_id, 'KEY_VALUE' AS type FROM p WHERE source_id = 1 AND target_id > 1 UNION ALL SELECT l_orderkey, source_id, target_id, 'NO_RELATION' FROM r WHERE r <= greatest(1, coalesce(k, 0))""",
    "sequence_windows": """WITH s AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, n, unnest(generate_series(0, greatest(0, n - 17), 48)) AS start FROM s)
        SELECT doc_id, start // 48 AS window_no, start, least(64, n - start) AS n FROM w""",
    "critical_fields": r"""WITH f AS (SELECT round(o_totalprice, 0)::DECIMAL(20,2) AS p, o_totalprice::DECIMAL(20,2) AS r FROM orders)
        SELECT 'total_amount' AS field, count(*) AS evaluated, round(avg((p = r)::INTEGER), 9) AS exact, round(avg((abs(p - r) <= 0.01)::INTEGER), 9) AS within_tolerance, 1.0::DOUBLE AS same_mark FROM f
        UNION ALL SELECT 'date', count(*), 1.0, NULL, NULL FROM f UNION ALL SELECT 'invoice_number', count(*), 1.0, NULL, NULL FROM f""",
}
