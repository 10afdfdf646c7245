"""Recognition and detection results: per sample, per page, per corpus, per field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.functions import text as X
from folioflow.operators.metrics import ratio

# The groups of critical fields.
FIELD_GROUPS = {
    "organization": ("organization", "organization_name"), "date": ("date",), "identifier": ("invoice_number", "receipt_number", "reference_number"), "amount": ("subtotal", "tax", "total_amount"),
    "currency": ("currency",), "email": ("email",), "phone": ("phone", "phone_number"), "address": ("address",),
}
CURRENCY_MARKS = ("$", "€", "£", "฿", "USD", "EUR", "THB")
SLICES = ("numeric", "amount", "date", "identifier", "currency", "email", "english")
BANDS = ((0.05, "small"), (0.20, "medium"))


def group_of(field: Column) -> Column:
    f = F.lower(field)
    return reduce(lambda acc, kv: F.when(f.isin(*kv[1]), F.lit(kv[0])).otherwise(acc), FIELD_GROUPS.items(), F.lit("generic"))


def samples(rows: DataFrame, reference: str, prediction: str, category: str) -> DataFrame:
    """Adds errors, lengths and exact matches (NULL in slices that don't apply) of each sample."""
    ref, pred = X.folded(F.col(reference)), X.folded(F.col(prediction))
    exact, cat = ref == pred, F.lower(F.coalesce(category, F.lit("")))
    applies = {
        "numeric": F.col(reference).rlike(r"\d"), "amount": F.contains(cat, F.lit("amount")), "date": F.contains(cat, F.lit("date")), "identifier": F.contains(cat, F.lit("identifier")) | cat.isin("invoice", "receipt", "reference"),
        "currency": F.contains(cat, F.lit("currency")) | X.contains_any(F.col(reference), CURRENCY_MARKS), "email": F.contains(cat, F.lit("email")), "english": F.lower(reference).rlike("[a-z]"),
    }
    tr, tp = X.turkish_letters(F.col(reference)), X.turkish_letters(F.col(prediction))
    turkish = F.when(F.length(tr) > 0, F.greatest(F.lit(0.0), 1 - F.levenshtein(tr, tp) / F.length(tr)))
    cer = ratio(F.levenshtein(ref, pred), F.greatest(F.lit(1), F.length(ref)))
    return rows.withColumns({"characters": F.length(ref), "errors": F.levenshtein(ref, pred), "coverage": F.greatest(F.lit(0.0), 1 - cer), "exact": exact, "turkish_accuracy": turkish, **{f"{k}_exact": F.when(v, exact) for k, v in applies.items()}})


def corpus(rows: DataFrame, by: list[str], confidence: str) -> DataFrame:
    """Corpus figures of :func:`samples`: summed errors over summed characters, means that skip NULL."""
    mean = lambda c: F.avg(F.col(c).cast("double"))
    y = F.col("exact").cast("double")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.sum("characters").alias("characters"), F.sum("errors").alias("errors"), (F.sum("errors") / F.greatest(F.lit(1), F.sum("characters"))).alias("cer"), mean("exact").alias("exact"),
        *[mean(f"{s}_exact").alias(f"{s}_exact") for s in SLICES], mean("turkish_accuracy").alias("turkish_accuracy"), F.avg((F.col(confidence) - y) * (F.col(confidence) - y)).alias("brier"),
    )


def field_metrics(pairs: DataFrame, field: str, reference: str, prediction: str, tolerance: float = 0.01) -> DataFrame:
    """Adds the metrics of a field's kind; a missing prediction fails, an empty reference is left out.

    ``exact`` is the kind's own measure: equal numbers, equal identifiers, or
    for organisations and addresses a similarity of 0.90 with a recall of 0.80.
    """
    p = pairs.where(F.trim(reference) != "").withColumns({"_r": F.col(reference), "_p": F.coalesce(prediction, F.lit("")), "group": group_of(F.col(field))})
    r, q = F.col("_r"), F.col("_p")
    nr, nq = X.loose_decimal(r), X.loose_decimal(q)
    same = lambda a, b: (a == b) & (a != "")
    false = F.lit(False)
    wanted, seen = X.tokens(r), X.tokens(q)
    hits = F.aggregate(F.array_distinct(wanted), F.lit(0), lambda acc, w: acc + F.least(F.size(F.filter(wanted, lambda x: x == w)), F.size(F.filter(seen, lambda x: x == w))))
    recall = F.coalesce(ratio(hits, F.nullif(F.size(wanted), F.lit(0))), F.lit(0.0))
    p = p.withColumn("similarity", F.when(F.col("group").isin("organization", "address"), X.similarity(r, q))).withColumn("token_recall", F.when(F.col("group").isin("organization", "address"), recall))
    kind = F.col("group")
    exact = (
        F.when(kind == "date", same(X.iso_date(r), X.iso_date(q))).when(kind == "amount", F.coalesce(nr == nq, false)).when(kind == "identifier", same(X.alphanumeric(r), X.alphanumeric(q)))
        .when(kind == "currency", same(X.currency_code(r), X.currency_code(q))).when(kind == "email", F.lower(F.trim(r)) == F.lower(F.trim(q))).when(kind == "phone", same(X.digits(r), X.digits(q)))
        .when(kind.isin("organization", "address"), (F.col("similarity") >= 0.90) & (F.col("token_recall") >= 0.80)).otherwise(X.folded(r) == X.folded(q))
    )
    return p.withColumns({
        "exact": exact, "within_tolerance": F.when(kind == "amount", F.coalesce(F.abs(nr - nq) <= F.lit(str(tolerance)).cast("decimal(10,4)"), false)),
        "same_mark": F.when(kind == "amount", F.coalesce(X.decimal_mark(r) == X.decimal_mark(q), false)),
    }).drop("_r", "_p")


def field_summary(scored: DataFrame, by: list[str]) -> DataFrame:
    d = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("evaluated"), d("exact"), d("within_tolerance"), d("same_mark"), d("similarity"), d("token_recall"))


def detector_pages(references: DataFrame, predictions: DataFrame, matches: DataFrame, page: str, height: float) -> DataFrame:
    """Counts per page: matched, expected, predicted, and by size band and for critical regions."""
    h = (F.col("y1") - F.col("y0")) / height
    band = F.when(h <= BANDS[0][0], BANDS[0][1]).when(h <= BANDS[1][0], BANDS[1][1]).otherwise("large")
    r = references.withColumn("band", band).join(matches.select(page, F.col("ref_id").alias("id"), F.lit(True).alias("hit")), [page, "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    one = lambda c, name: F.count_if(c).alias(name)
    g = r.groupBy(page).agg(
        one(F.col("hit"), "true_positive"), F.count(F.lit(1)).alias("expected"), *[x for b in ("small", "medium", "large") for x in (one(F.col("band") == b, f"{b}_expected"), one((F.col("band") == b) & F.col("hit"), f"{b}_matched"))],
        one(F.col("critical"), "critical_expected"), one(F.col("critical") & F.col("hit"), "critical_matched"),
    )
    p = predictions.groupBy(page).agg(F.count(F.lit(1)).alias("predicted"))
    return g.join(p, page, "full").fillna(0)


def detector_corpus(pages: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and recalls by size from summed counts; no mean of ratios."""
    n = {c: F.sum(c) for c in pages.columns if pages.schema[c].dataType.typeName() == "long" and c not in by}
    g = pages.groupBy(*by).agg(*[v.alias(k) for k, v in n.items()])
    z = lambda a, b: F.coalesce(ratio(F.col(a), F.nullif(F.col(b), F.lit(0))), F.lit(0.0))
    g = g.withColumns({"precision": z("true_positive", "predicted"), "recall": z("true_positive", "expected")})
    g = g.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    return g.withColumns({f"{b}_recall": ratio(F.col(f"{b}_matched"), F.nullif(F.col(f"{b}_expected"), F.lit(0))) for b in ("small", "medium", "large", "critical")})


def route_reasons(mean_confidence: Column, words: Column, valid_ratio: Column, text: Column, hint: Column, least: float = 0.55) -> Column:
    """Why the Thai recogniser should be tried, too."""
    tests = {"metadata_or_user_hint_is_thai": F.lower(hint).isin("th", "thai", "th-th"), "general_output_contains_thai_script": X.contains_thai(text), "general_confidence_is_low": mean_confidence < least, "general_output_is_empty_or_weak": words < 2, "general_output_has_low_valid_character_ratio": valid_ratio < 0.8}
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in tests.items()]))


def route_for_mode(mode: Column) -> Column:
    m = F.lower(F.trim(F.coalesce(mode, F.lit("auto"))))
    return F.when(m.isin("general", "en", "tr"), "general").when(m.isin("thai", "th"), "thai")


def best_candidate(candidates: DataFrame, by: list[str], score: Column, name: str, first: str) -> DataFrame:
    """The candidate of best score; of equals the one named ``first``, then by name."""
    return candidates.groupBy(*by).agg(F.max_by(name, F.struct(score, (F.col(name) == first).cast("int"), F.col(name))).alias("selected"), F.max(score).alias("score"))


def second_pass(first: Column, second: Column, gain: float = 0.0) -> Column:
    """Whether the second rendering replaces the first."""
    return F.coalesce(second > first + gain, F.lit(False))


def top_gap(scores: Column) -> Column:
    """Best less second best finite score; NULL with fewer than two."""
    s = F.sort_array(F.filter(scores, lambda x: x.isNotNull() & ~F.isnan(x)), False)
    return F.when(F.size(s) >= 2, F.try_element_at(s, F.lit(1)) - F.try_element_at(s, F.lit(2)))


def nearest_cardinal(angle: Column) -> Column:
    a = F.pmod(angle, F.lit(360.0))
    each = F.array(*[F.struct(F.least(F.abs(a - c), 360.0 - F.abs(a - c)).alias("e"), F.lit(c).alias("c")) for c in (0, 90, 180, 270)])
    return F.array_min(each).c


def confusable_orientation(angle: Column, apart: float = 30.0) -> Column:
    """Aggregate: at least four angles, two of which differ by ``apart`` degrees (up to 45) modulo a half turn.

    The half turn is cut into sectors no narrower than ``apart``, so angles in
    sectors that don't touch are apart, and those of one or of two neighbouring
    sectors are if the largest and the smallest are.  It combines on the map
    side and keeps no list.  Angles that aren't finite are left out.
    """
    k = int(180 // apart)
    assert k >= 4, "apart is more than 45 degrees"
    inside = F.when(F.abs(angle) < float("inf"), F.pmod(angle, F.lit(180.0)))
    sector = F.least(F.lit(k - 1), F.floor(inside / (180.0 / k)))
    low, high = ([f(F.when(sector == i, inside)) for i in range(k)] for f in (F.min, F.max))
    wide = lambda d: F.coalesce(d >= apart - 1e-9, F.lit(False))
    found = [wide(high[i] - low[i]) for i in range(k)] + [wide(high[(i + 1) % k] + 180.0 * (i + 1 == k) - low[i]) for i in range(k)]
    found += [low[i].isNotNull() & low[j].isNotNull() for i in range(k) for j in range(i + 2, k) if i + k - j > 1]
    return (F.count(inside) >= 4) & reduce(lambda p, q: p | q, found)
