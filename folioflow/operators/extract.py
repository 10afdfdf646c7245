"""Fields, entities, relations and tables from lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioflow.functions import text as X
from folioflow.functions.ids import stable_id

MONEY_FIELDS = ("subtotal", "discount", "service_charge", "tax", "total_amount", "paid_amount", "balance")
LABEL_FIELDS = ("vendor_name", "customer_name", "person_name", "bank_name", "account_reference")
NUMBER_FIELDS = ("invoice_number", "receipt_number", "reference_number", "tax_identification_number", "customer_account_number")
#: (source label, target label) -> relation
RELATIONS = {("KEY", "VALUE"): "KEY_VALUE", ("QUESTION", "ANSWER"): "QUESTION_ANSWER", ("HEADER", "SECTION"): "HEADER_SECTION", ("TABLE_HEADER", "TABLE_CELL"): "TABLE_HEADER_CELL"}


def rule_candidates(lines: DataFrame, text: str = "text", confidence: str = "confidence") -> DataFrame:
    """One row per field that a line gives evidence for: field, value, raw_text, confidence.

    All columns of ``lines`` are kept.  A line without confidence counts 0.5;
    amounts named by a sure keyword gain 0.06.  Null and blank lines give none.
    """
    t = F.trim(F.col(text))
    keep = lines.columns
    if_has = lambda mark, value: F.when(mark, value)  # noqa: E731  patterns run only where they can match
    digit = t.rlike(r"\d")
    # each pattern runs once per line: later columns refer to these
    lines = lines.where(F.length(t) > 0).withColumns({"_t": t, "_low": F.lower(t)})
    t, low = F.col("_t"), F.col("_low")
    lines = lines.withColumns({
        "_email": if_has(F.contains(t, F.lit("@")), X.found(t, X.EMAIL)), "_site": if_has(F.contains(low, F.lit("www.")) | F.contains(low, F.lit("://")), X.found(t, X.WEBSITE)),
        "_phone": if_has(digit, F.regexp_extract(t, X.PHONE, 0)), "_date": if_has(digit, F.regexp_extract(t, X.DATE, 0)), "_time": if_has(digit & F.contains(t, F.lit(":")), F.regexp_extract(t, X.TIME, 0)),
        "_number": if_has(F.contains(t, F.lit(":")) | F.contains(t, F.lit("#")), F.regexp_extract(t, X.NUMBER, 0)), "_money": if_has(digit, X.last_money(t)), "_label": X.after_label(t),
        "_conf": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(confidence), F.lit(0.5)))),
    })
    lines = lines.withColumn("_amount", X.money(F.col("_money")))
    conf = F.col("_conf")
    sure = F.least(F.lit(1.0), conf + 0.06)
    given = lambda name: F.when(F.col(name) != "", F.col(name))

    def one(name: str, value: Column, raw: Column, c: Column = conf) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"), raw.alias("raw_text"), c.alias("field_confidence")))

    has = lambda name: X.contains_any(low, X.KEYWORDS[name])
    email, phone, number_raw, raw_money, value_money, label = F.col("_email"), given("_phone"), given("_number"), F.col("_money"), F.col("_amount"), F.col("_label")
    site = F.regexp_replace("_site", r"[.,;)]+$", "")
    number = F.regexp_replace(number_raw, r"^[:#]\s*", "")
    cells = [
        one("email", email, email),
        one("website", F.when(~F.contains(site, F.lit("@")), site), site),
        one("phone_number", F.regexp_replace(phone, r"[^+\d]", ""), phone),
        one("date", given("_date"), given("_date")),
        one("time", given("_time"), given("_time")),
    ]
    cells += [one(f, F.when(has(f), number), number_raw) for f in NUMBER_FIELDS]
    for f in MONEY_FIELDS:
        named = has(f)
        if f == "total_amount":
            named = named & ~has("subtotal")
        if f == "tax":
            named = named & ~has("tax_identification_number")
        plain = ~(F.contains(low, F.lit("grand")) | F.contains(low, F.lit("due"))) if f == "total_amount" else F.lit(False)
        cells.append(one(f, F.when(named, value_money), raw_money, F.when(plain, conf).otherwise(sure)))
    cells.append(one("payment_method", F.when(has("payment_method"), X.first_case(low, X.PAYMENTS)), t))
    cells += [one(f, F.when(has(f), label), t) for f in ("address", *LABEL_FIELDS)]
    cells.append(one("currency", X.currency(t), t))
    cells.append(one("document_title", X.first_case(low, X.TITLES), t))
    return lines.withColumn("_c", F.explode(F.array_compact(F.array(*cells)))).select(*keep, "_c.*")


def header_organization(lines: DataFrame, by: list[str]) -> DataFrame:
    """The topmost mostly upper-case line in the upper quarter of each page; a line without confidence counts 0.5."""
    t = F.trim(F.col("text"))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(t, r"[^\p{Lu}]", ""))
    ok = (F.length(t) >= 3) & (letters > 0) & ~t.rlike(X.HEADER_WORDS) & (upper / letters >= 0.5)
    # the topmost such line is the answer or there is none: one aggregate finds it and the page's end
    place = F.when(ok, F.struct("y0", "x0", "line_no"))
    best = lines.groupBy(*by).agg(F.max("y1").alias("_bottom"), F.min_by(F.struct("line_no", "text", "confidence", "y0"), place).alias("_b")).where(F.col("_b.y0") <= F.col("_bottom") * 0.25)
    return best.select(*by, F.col("_b.line_no").alias("line_no"), F.lit("organization_name").alias("field"), F.trim("_b.text").alias("value"), F.trim("_b.text").alias("raw_text"), (F.coalesce("_b.confidence", F.lit(0.5)) * 0.75).alias("field_confidence"))


def best_fields(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Per field the evidence of highest confidence; of equals the earliest line.

    ``conflict`` tells that the candidates name different values.  An ordered
    aggregate, so evidence is reduced before it is shuffled.
    """
    pick = F.max_by(F.struct("value", "raw_text", "field_confidence", "line_no"), F.struct("field_confidence", -F.col("line_no"), "raw_text"))
    agg = candidates.groupBy(*by, "field").agg(pick.alias("_b"), (F.min("value") != F.max("value")).alias("conflict"))
    return agg.select(*by, "field", F.col("_b.value").alias("value"), F.col("_b.raw_text").alias("raw_text"), F.col("_b.field_confidence").alias("confidence"), F.col("_b.line_no").alias("line_no"), "conflict")


def total_consistency(best: DataFrame, by: list[str]) -> DataFrame:
    """Do the parts of a document add up to its total, and total less paid to the balance?"""
    d = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).try_cast("decimal(20,2)").alias(f)
    wide = best.groupBy(*by).agg(*[d(f) for f in MONEY_FIELDS])
    zero = F.lit(0).cast("decimal(20,2)")
    expected = F.col("subtotal") + F.col("tax") + F.coalesce("service_charge", zero) - F.coalesce("discount", zero)
    tolerance = F.greatest(F.lit("0.05").cast("decimal(20,4)"), F.abs("total_amount") * F.lit("0.02").cast("decimal(4,2)"))
    parts = F.when(expected.isNull() | F.col("total_amount").isNull(), "not_checked").when(F.abs(expected - F.col("total_amount")) > tolerance, "conflict").otherwise("validated")
    rest = F.col("total_amount") - F.col("paid_amount") - F.col("balance")
    return wide.select(
        *by, *MONEY_FIELDS, parts.alias("total_status"), (F.col("total_amount") < F.col("subtotal")).alias("total_below_subtotal"),
        F.when(rest.isNull(), "not_checked").when(F.abs(rest) > tolerance, "conflict").otherwise("validated").alias("balance_status"),
    )


def key_values(lines: DataFrame, page: str = "page_number") -> DataFrame:
    """Two entities per ``key: value`` line, the box divided in proportion to the key's length."""
    t = F.trim(F.col("text"))
    key, value = F.regexp_extract(t, r"^(.*?)\s*[:：]\s*(.*)$", 1), F.regexp_extract(t, r"^(.*?)\s*[:：]\s*(.*)$", 2)
    part = F.least(F.lit(0.8), F.greatest(F.lit(0.2), F.length(key) / F.greatest(F.length(t), F.lit(1))))
    cut = F.col("x0") + (F.col("x1") - F.col("x0")) * part
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.5)) * 0.8))

    def one(role: str, said: Column, a: Column, b: Column) -> Column:
        return F.struct(
            stable_id("generic_entity", F.col(page), F.col("line_no"), F.lit(role), said).alias("entity_id"), F.lit(role).alias("label"), said.alias("entity_text"), a.alias("ex0"), F.col("y0").alias("ey0"), b.alias("ex1"), F.col("y1").alias("ey1"), conf.alias("entity_confidence")
        )

    both = F.explode(F.array(one("KEY", key, F.col("x0"), cut), one("VALUE", value, cut, F.col("x1"))))
    return lines.where((key != "") & (value != "")).select("doc_id", page, "line_no", both.alias("e")).select("doc_id", page, "line_no", "e.*")


def pair_features(s: str, t: str) -> dict[str, Column]:
    """Ten geometric features of two boxes (columns ex0, ey0, ex1, ey1 of aliases s and t)."""
    c = lambda a, n: F.col(f"{a}.{n}")
    sx0, sy0, sx1, sy1, tx0, ty0, tx1, ty1 = (c(a, n) for a in (s, t) for n in ("ex0", "ey0", "ex1", "ey1"))
    zero, tiny = F.lit(0.0), F.lit(1e-6)
    dx, dy = (tx0 + tx1) / 2 - (sx0 + sx1) / 2, (ty0 + ty1) / 2 - (sy0 + sy1) / 2
    inter = F.greatest(zero, F.least(sx1, tx1) - F.greatest(sx0, tx0)) * F.greatest(zero, F.least(sy1, ty1) - F.greatest(sy0, ty0))
    area = lambda x0, y0, x1, y1: F.greatest(tiny, x1 - x0) * F.greatest(tiny, y1 - y0)
    return {
        "delta_x": dx, "delta_y": dy, "distance": F.sqrt(dx * dx + dy * dy),
        "horizontal_gap": F.greatest(zero, tx0 - sx1, sx0 - tx1), "vertical_gap": F.greatest(zero, ty0 - sy1, sy0 - ty1),
        "iou": inter / F.greatest(tiny, area(sx0, sy0, sx1, sy1) + area(tx0, ty0, tx1, ty1) - inter),
        "same_line": (F.greatest(sy0, ty0) <= F.least(sy1, ty1)).cast("double"), "same_column": (F.greatest(sx0, tx0) <= F.least(sx1, tx1)).cast("double"),
        "target_is_right": (dx >= 0).cast("double"), "target_is_below": (dy >= 0).cast("double"),
    }


def relation_candidates(entities: DataFrame, reach: float = 0.6) -> DataFrame:
    """Pairs of one page whose labels fit and whose distance is at most ``reach`` of the page's extent."""
    spark = entities.sparkSession
    fits = F.broadcast(spark.createDataFrame([(a, b, r) for (a, b), r in RELATIONS.items()], "sl string, tl string, relation_type string"))
    extent = entities.groupBy("doc_id").agg(F.max(F.greatest("ex1", "ey1")).alias("extent"))
    keys = ["doc_id", "page_number"]
    sources = entities.where(F.col("label").isin(*[a for a, _ in RELATIONS])).join(extent, "doc_id")
    targets = entities.where(F.col("label").isin(*[b for _, b in RELATIONS]))
    s, t = sources.alias("s"), targets.alias("t")
    pairs = s.join(t, [F.col(f"s.{k}") == F.col(f"t.{k}") for k in keys] + [F.col("s.entity_id") != F.col("t.entity_id")]).join(fits, (F.col("s.label") == F.col("sl")) & (F.col("t.label") == F.col("tl")))
    f = pair_features("s", "t")
    out = pairs.select(F.col("s.doc_id").alias("doc_id"), F.col("s.page_number").alias("page_number"), F.col("s.entity_id").alias("source_id"), F.col("t.entity_id").alias("target_id"), "relation_type", (f["distance"] / F.greatest(F.lit(1.0), F.col("s.extent"))).alias("normalized_distance"), *[v.alias(k) for k, v in f.items()])
    return out.where(F.col("normalized_distance") <= reach)


def candidate_cost(normalized_distance: str = "normalized_distance") -> Column:
    back = (F.col("target_is_right") == 0) & (F.col("target_is_below") == 0)
    return F.col(normalized_distance) + F.when(back, 0.25).otherwise(0.0) - F.when(F.col("same_line") == 1, 0.15).otherwise(0.0)


def best_relations(candidates: DataFrame) -> DataFrame:
    """For each source and relation the target of least cost."""
    order = F.struct(candidate_cost().alias("c"), "vertical_gap", "horizontal_gap", "target_id")
    best = candidates.groupBy("doc_id", "page_number", "source_id", "relation_type").agg(F.min_by(F.struct("target_id", "normalized_distance"), order).alias("b"))
    return best.select("doc_id", "page_number", "source_id", "relation_type", F.col("b.target_id").alias("target_id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("b.normalized_distance"))).alias("confidence"))


def bio_tags(tokens: DataFrame, by: list[str], order: str, label: str, entity: str, other: str = "OTHER") -> DataFrame:
    """B-/I- tags: a token continues where the one before has its label and entity."""
    w = W.partitionBy(*by).orderBy(order)
    same = (F.lag(label).over(w) == F.col(label)) & F.lag(entity).over(w).eqNullSafe(F.col(entity))
    tag = F.when(F.col(label) == other, "O").otherwise(F.concat(F.when(F.coalesce(same, F.lit(False)), "I-").otherwise("B-"), F.col(label)))
    return tokens.withColumn("tag", tag)


def runs(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values: value, first and last place, length (gaps and islands)."""
    w = W.partitionBy(*by).orderBy(order)
    step = rows.withColumn("_new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    step = step.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return step.groupBy(*by, F.col("_run").alias("run_no")).agg(F.first(value).alias("run_value"), F.min(order).alias("first_at"), F.max(order).alias("last_at"), F.count(F.lit(1)).alias("run_length"))


def fuse_pages(left: DataFrame, right: DataFrame, by: list[str], margin: float = 0.15) -> DataFrame:
    """Two sources of a field: agreement keeps the surer, a clear lead wins, else abstain.

    Columns value and confidence on both sides; ``decision`` tells the case.
    """
    l, r = left.alias("l"), right.alias("r")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
    lv, rv, lc, rc = F.col("l.value"), F.col("r.value"), F.col("l.confidence"), F.col("r.confidence")
    agree = X.folded(lv) == X.folded(rv)
    decision = (
        F.when(lv.isNull(), "right_only").when(rv.isNull(), "left_only").when(agree, "agree")
        .when(lc - rc >= margin, "left_wins").when(rc - lc >= margin, "right_wins").otherwise("abstain")
    )
    take_left = decision.isin("left_only", "left_wins") | ((decision == "agree") & (lc >= rc))
    return l.join(r, on, "full").select(
        *[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in by], decision.alias("decision"),
        F.when(decision == "abstain", None).when(take_left, lv).otherwise(rv).alias("value"), F.when(decision == "abstain", None).when(take_left, lc).otherwise(rc).alias("confidence"),
    )


def fuse_document(values: DataFrame, by: list[str], margin: float = 0.10) -> DataFrame:
    """Evidence of all pages: score = best confidence + 0.03 a repetition (0.10 at most); abstain in a near tie."""
    grouped = values.where(F.col("value").isNotNull()).groupBy(*by, X.folded(F.col("value")).alias("folded")).agg(F.max_by("value", F.struct("confidence", "value")).alias("value"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))
    scored = grouped.withColumn("score", F.col("confidence") + F.least(F.lit(0.10), 0.03 * (F.col("n") - 1)))
    w = W.partitionBy(*by).orderBy(F.desc("score"), "folded")
    ranked = scored.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w)).where("_r = 1")
    tie = F.coalesce(F.col("score") - F.col("_next") < margin, F.lit(False))
    return ranked.select(*by, F.when(tie, None).otherwise(F.col("value")).alias("value"), "score", "n", tie.alias("abstained"))


def fuse_types(values: DataFrame, by: list[str], label: str, confidence: str, margin: float = 0.10) -> DataFrame:
    """Document type of highest mean confidence over pages; unknown in a near tie."""
    mean = values.groupBy(*by, label).agg(F.avg(confidence).alias("mean"))
    w = W.partitionBy(*by).orderBy(F.desc("mean"), label)
    top = mean.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("mean").over(w)).where("_r = 1")
    tie = F.coalesce(F.col("mean") - F.col("_next") < margin, F.lit(False))
    return top.select(*by, F.when(tie, "unknown").otherwise(F.col(label)).alias("document_type"), F.when(tie, None).otherwise(F.col("mean")).alias("confidence"))


def merge_missing(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and those rows of ``extra`` whose keys it hasn't, one per key."""
    first = extra.dropDuplicates(keys)
    return base.unionByName(first.join(base.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def detected_languages(text: Column) -> Column:
    """Scripts seen in a text: th, tr; en where neither is."""
    th, tr = X.contains_thai(text), text.rlike("[çğıöşüÇĞİÖŞÜ]")
    return F.array_compact(F.array(F.when(th, "th"), F.when(tr, "tr"), F.when(~th & ~tr, "en")))
