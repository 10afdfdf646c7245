"""Rows for and from learned models: spans, supervision, decoding, windows, examples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioflow.functions.ids import rank_key, stable_id
from folioflow.operators.extract import RELATIONS

IGNORED = -100


def argmax(vector: Column) -> Column:
    """Index (from 0) of the first largest value."""
    return F.array_position(vector, F.array_max(vector)).cast("int") - 1


def token_spans(tokens: DataFrame, by: list[str], order: str, tag: str) -> DataFrame:
    """Entities of B-/I- tags: label, first, last, text, box, mean confidence.

    A span begins at B-, or at I- of another label than the span before; O ends it.
    """
    w = W.partitionBy(*by).orderBy(order)
    label, head = F.regexp_extract(tag, "^[BI]-(.*)$", 1), F.substring(tag, 1, 2)
    t = tokens.withColumns({"_label": label, "_head": head})
    begins = (F.col("_label") != "") & ((F.col("_head") == "B-") | (F.coalesce(F.lag("_label").over(w), F.lit("")) != F.col("_label")))
    t = t.withColumn("_span", F.sum(begins.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("_label <> ''")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda s: s.t), " ")
    return t.groupBy(*by, "_span").agg(
        F.min("_label").alias("label"), F.min(order).alias("first_at"), F.max(order).alias("last_at"), words.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("confidence").alias("confidence")
    ).withColumnRenamed("_span", "span_no")


def decode_fields(tokens: DataFrame, by: list[str], order: str, vector: str, labels: list[str], thresholds: dict[str, float], default: float) -> DataFrame:
    """Best span per field: argmax of each word above its field's threshold, runs of one field, the surest and then longest.

    ``labels[0]`` is no field; words below their threshold break a run.
    """
    names = F.array(*[F.lit(x) for x in labels])
    best = argmax(F.col(vector))
    conf = F.array_max(vector)
    name = F.element_at(names, best + 1)
    floor = reduce(lambda acc, kv: F.when(name == kv[0], kv[1]).otherwise(acc), thresholds.items(), F.lit(default))
    t = tokens.withColumns({"_field": F.when((best > 0) & (conf >= floor), name), "_conf": conf})
    w = W.partitionBy(*by).orderBy(order)
    t = t.withColumn("_new", (~F.lag("_field").over(w).eqNullSafe(F.col("_field"))).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).where("_field IS NOT NULL")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda s: s.t), " ")
    spans = t.groupBy(*by, "_field", "_run").agg(text.alias("value"), F.avg("_conf").alias("confidence"), F.min(order).alias("first_at"))
    return spans.groupBy(*by, F.col("_field").alias("field")).agg(F.max_by(F.struct("value", "confidence", "first_at"), F.struct("confidence", F.length("value"), -F.col("_run"))).alias("b")).select(*by, "field", "b.value", "b.confidence", "b.first_at")


def decode_type(vector: Column, labels: list[str], threshold: float) -> Column:
    name = F.element_at(F.array(*[F.lit(x) for x in labels]), argmax(vector) + 1)
    return F.when((F.array_max(vector) < threshold) | (name == "other"), "unknown").otherwise(name)


def decode_relation(vector: Column, labels: list[str], expected: Column, threshold: float) -> Column:
    """The relation's type; NULL where none is sure enough or its labels don't fit."""
    name = F.element_at(F.array(*[F.lit(x) for x in labels]), argmax(vector) + 1)
    ok = (name != "NO_RELATION") & (F.array_max(vector) >= threshold) & ((name == expected) | (name == "OTHER_RELATION"))
    return F.when(ok & (name == "OTHER_RELATION"), "GENERIC").when(ok, name)


def field_supervision(tokens: DataFrame, evidence: DataFrame, page: str, token: str, names: dict[str, int]) -> DataFrame:
    """(page, token, label_id): the field that a token is evidence for; 0 none, IGNORED where fields disagree or the token is masked."""
    known = evidence.where(F.col("field").isin(*names)).groupBy(page, token).agg(F.min("field").alias("f"), (F.min("field") != F.max("field")).alias("torn"))
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return tokens.join(known, [page, token], "left").select(page, token, F.when(~F.col("masked_in") | F.coalesce("torn", F.lit(False)), IGNORED).otherwise(F.coalesce(F.element_at(lookup, F.col("f")), F.lit(0))).alias("label_id"))


def relation_supervision(pairs: DataFrame, positives: DataFrame, page: str, per_positive: int = 3, seed: str = "42") -> DataFrame:
    """Positives and the hardest negatives of a page: labels that fit first, then the nearest, then by hash.

    ``pairs`` holds (page, source_id, target_id, source_label, target_label,
    distance), ``positives`` (page, source_id, target_id, type).
    """
    key = [page, "source_id", "target_id"]
    pos = positives.select(*key, "type").distinct()
    n = pos.groupBy(page).agg(F.count(F.lit(1)).alias("_n"))
    fits = reduce(lambda a, b: a | b, [(F.col("source_label") == a) & (F.col("target_label") == b) for a, b in RELATIONS])
    neg = pairs.where("source_id <> target_id").join(pos, key, "left_anti").join(n, page, "left")
    order = W.partitionBy(page).orderBy((~fits).cast("int"), "distance", rank_key(F.concat_ws("|", page, "source_id", "target_id"), seed))
    hard = neg.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_positive * F.greatest(F.lit(1), F.coalesce("_n", F.lit(0))))
    return pos.unionByName(hard.select(*key, F.lit("NO_RELATION").alias("type")))


def windows(sequences: DataFrame, key: str, items: str, length: int = 512, stride: int = 64) -> DataFrame:
    """Overlapping windows of a sequence: (key, window_no, start, items); an empty sequence has none."""
    n = F.size(items)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - stride - 1), F.lit(length - stride))
    w = sequences.where(n > 0).select(key, items, F.posexplode(starts).alias("window_no", "start"))
    return w.select(key, "window_no", "start", F.slice(items, F.col("start") + 1, length).alias("items"))


def first_pieces(pieces: DataFrame, by: list[str], order: str, word: str) -> DataFrame:
    """Marks the first piece of every word: it carries the label, the others are ignored."""
    w = W.partitionBy(*by, word).orderBy(order)
    return pieces.withColumn("carries_label", F.col(word).isNotNull() & (F.row_number().over(w) == 1))


def deskew(words: DataFrame, page: str, least: float = 8.0, steepest: float = 45.0) -> DataFrame:
    """Correction angle of each page: the weighted median of its words' baselines.

    Columns p0..p3 are the corners (arrays of x and y).  Reliability weighs
    support, concentration and confidence; a page without usable words turns
    by 0 and is not reliable.
    """
    def edge(a: str, b: str) -> Column:
        dx, dy = F.col(b)[0] - F.col(a)[0], F.col(b)[1] - F.col(a)[1]
        turn = F.degrees(F.atan2(F.when(dx < 0, -dy).otherwise(dy), F.abs(dx)))
        turn = F.when(turn >= 90, turn - 180).otherwise(turn)
        n = F.sqrt(dx * dx + dy * dy)
        return F.when((n >= least) & (F.abs(turn) <= steepest), F.struct(n.alias("n"), turn.alias("angle")))

    best = F.array_max(F.array_compact(F.array(edge("p0", "p1"), edge("p3", "p2"))))
    o = words.select(page, best.alias("e"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0)))).alias("c")).where("e IS NOT NULL")
    o = o.select(page, "c", F.col("e.n").alias("n"), F.col("e.angle").alias("angle"), (F.col("e.n") * F.greatest(F.lit(0.1), F.col("c"))).alias("w"))
    mid = _weighted_median(o, page, "angle", "w").withColumnRenamed("m", "text_angle")
    spread = _weighted_median(o.join(mid, page).withColumn("dev", F.abs(F.col("angle") - F.col("text_angle"))), page, "dev", "w").withColumnRenamed("m", "dispersion")
    g = o.groupBy(page).agg(F.count(F.lit(1)).alias("supported"), F.sum("n").alias("_len"), F.avg("c").alias("_c")).join(mid, page).join(spread, page)
    support = F.greatest(F.least(F.lit(1.0), F.col("supported") / 6.0), F.least(F.lit(1.0), F.col("_len") / 300.0))
    sure = support * F.greatest(F.lit(0.0), 1 - F.col("dispersion") / 12.0) * F.col("_c")
    known = g.select(page, "text_angle", sure.alias("reliability"), "dispersion", "supported")
    every = words.select(page).distinct().join(known, page, "left")
    return every.select(page, F.coalesce("text_angle", F.lit(0.0)).alias("text_angle"), F.coalesce("reliability", F.lit(0.0)).alias("reliability"), F.coalesce("dispersion", F.lit(90.0)).alias("dispersion"), F.coalesce("supported", F.lit(0)).alias("supported"))


def _weighted_median(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    win = W.partitionBy(by).orderBy(value)
    g = rows.groupBy(by, value).agg(F.sum(weight).alias("_w"))
    c = g.withColumn("_cum", F.sum("_w").over(win.rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_w").over(W.partitionBy(by)))
    return c.where(F.col("_cum") >= F.col("_all") / 2 - 1e-9).groupBy(by).agg(F.min(value).alias("m"))


def matched_example(tokens: DataFrame, matches: DataFrame, page: str, label: str = "label") -> DataFrame:
    """Recognised tokens with the labels of the reference tokens they were matched to.

    Labels that agree are taken; where they differ the most frequent wins, of
    equals the first by name; unmatched tokens are OTHER.
    """
    votes = matches.groupBy(page, "other_id", label).agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy(page, F.col("other_id").alias("id")).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("_l"), F.count(F.lit(1)).alias("_kinds"))
    return tokens.join(best, [page, "id"], "left").withColumns({"label": F.coalesce("_l", F.lit("OTHER")), "ambiguous": F.coalesce(F.col("_kinds") > 1, F.lit(False))}).drop("_l", "_kinds")


def hybrid_tokens(reference: DataFrame, recognised: DataFrame, matches: DataFrame, page: str) -> DataFrame:
    """Reference tokens with recognised text where matched (each recognised token once), then the recognised rest.

    ``origin`` tells ocr, source (no match) or extra.
    """
    first = matches.groupBy(page, "other_id").agg(F.min("ref_id").alias("ref_id"))
    pick = first.groupBy(page, "ref_id").agg(F.min("other_id").alias("other_id"))
    said = recognised.select(page, F.col("id").alias("other_id"), F.col("text").alias("ocr_text"))
    own = reference.select(page, F.col("id").alias("ref_id"), "text").join(pick, [page, "ref_id"], "left").join(said, [page, "other_id"], "left")
    own = own.select(page, "ref_id", F.col("other_id"), F.coalesce("ocr_text", "text").alias("text"), F.when(F.col("ocr_text").isNull(), "source").otherwise("ocr").alias("origin"))
    rest = said.join(matches.select(page, "other_id").distinct(), [page, "other_id"], "left_anti").select(page, F.lit(None).alias("ref_id"), "other_id", F.col("ocr_text").alias("text"), F.lit("extra").alias("origin"))
    return own.unionByName(rest)


def merged_regions(tokens: DataFrame, page: str, box: list[str]) -> DataFrame:
    """Tokens of one rounded box merged: texts in order, ignored only if all are."""
    at = [F.round(c, 6).alias(c) for c in box]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda s: s.text), " ")
    return tokens.groupBy(page, *at).agg(text.alias("text"), F.min("id").alias("first_id"), F.bool_and("ignored").alias("ignored"), F.count(F.lit(1)).alias("tokens"))


def build_id(rows: DataFrame, columns: list[str], policy: str) -> DataFrame:
    """One digest of an inventory and its policy, whatever the order of the rows."""
    line = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    part = rows.groupBy(F.pmod(F.xxhash64(line), F.lit(4096)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ""), 256).alias("d"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda s: s.d), "")
    return part.agg(F.sum("n").alias("rows"), F.substring(F.sha2(F.concat(F.lit(policy), whole), 256), 1, 16).alias("build_id"))


def entity_ids(entities: DataFrame, page: str) -> DataFrame:
    return entities.withColumn("entity_id", stable_id("entity", F.col(page), F.col("span_no"), F.col("label"), F.col("first_at")))
