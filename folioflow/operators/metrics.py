"""Evaluation: matches, text and field metrics, calibration, thresholds, clustering, scores, gates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

EPS = 1e-12


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def f1(tp: Column, predicted: Column, expected: Column) -> Column:
    """2tp / (predicted + expected), 0 where both are 0."""
    return F.coalesce(ratio(2 * tp, predicted + expected), F.lit(0.0))


def multiset_match(left: DataFrame, right: DataFrame, by: list[str], item: str) -> DataFrame:
    """True positives, sizes and P/R/F1 of two multisets per group, from counts."""
    l = left.groupBy(*by, item).agg(F.count(F.lit(1)).alias("nl"))
    r = right.groupBy(*by, item).agg(F.count(F.lit(1)).alias("nr"))
    both = l.join(r, [*by, item], "full").fillna(0, ["nl", "nr"])
    agg = both.groupBy(*by).agg(F.sum(F.least("nl", "nr")).alias("tp"), F.sum("nl").alias("expected"), F.sum("nr").alias("predicted"))
    return agg.withColumns({"precision": F.coalesce(ratio(F.col("tp"), F.col("predicted")), F.lit(0.0)), "recall": F.coalesce(ratio(F.col("tp"), F.col("expected")), F.lit(0.0)), "f1": f1(F.col("tp"), F.col("predicted"), F.col("expected"))})


def character_errors(reference: Column, prediction: Column) -> Column:
    return F.levenshtein(reference, prediction)


def ece(rows: DataFrame, confidence: str, correct: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Expected calibration error over equal-width bins, and the Brier score."""
    by = by or []
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence)))
    b = F.least(F.lit(bins - 1), F.floor(c * bins))
    y = F.col(correct).cast("double")
    binned = rows.where(F.col(confidence).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.sum(c).alias("c"), F.sum(y).alias("y"), F.count(F.lit(1)).alias("n"), F.sum((c - y) * (c - y)).alias("sq"))
    return binned.groupBy(*by).agg((F.sum(F.abs(F.col("c") - F.col("y"))) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier"), F.sum("n").alias("n"))


def abstain(confidence: Column, prediction: Column, threshold: Column) -> Column:
    """The prediction, or class 0 where its confidence is below the threshold."""
    return F.when(confidence >= threshold, prediction).otherwise(0)


def positive_f1(rows: DataFrame, confidence: str, prediction: str, label: str, threshold: float) -> DataFrame:
    """Micro F1 of the positive classes; a wrong positive class is both kinds of error."""
    p = abstain(F.col(confidence), F.col(prediction), F.lit(threshold))
    hit = (F.col(label) > 0) & (p == F.col(label))
    agg = rows.agg(F.count_if(hit).alias("tp"), F.count_if(~hit & (p > 0)).alias("fp"), F.count_if(~hit & (F.col(label) > 0)).alias("fn"))
    return agg.withColumn("f1", F.coalesce(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def _sweep(counts: DataFrame, columns: list[str], ranges: int = 32) -> DataFrame:
    """Running sums of ``columns`` from the highest threshold down.

    ``counts`` has one row per distinct threshold in [0, 1].  The sums run
    within ranges of thresholds in parallel, and the ranges' totals (a fixed
    number of rows) are added up and joined back.
    """
    part = F.least(F.lit(ranges - 1), F.floor((1 - F.col("threshold")) * ranges)).cast("int")
    inner = W.partitionBy("_p").orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    c = counts.withColumn("_p", part)
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    totals = c.groupBy("_p").agg(*[F.sum(x).alias(f"_t{x}") for x in columns])
    offsets = totals.select("_p", *[F.coalesce(F.sum(f"_t{x}").over(before), F.lit(0)).alias(f"_o{x}") for x in columns])
    return c.join(F.broadcast(offsets), "_p").select("threshold", *[(F.sum(x).over(inner) + F.col(f"_o{x}")).alias(x) for x in columns])


def best_positive_threshold(rows: DataFrame, confidence: str, prediction: str, label: str) -> DataFrame:
    """(threshold, f1): the threshold of best positive F1, of equals the higher; 0.5 without rows, 1 if none helps."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence)))
    hit = (F.col(label) > 0) & (F.col(prediction) == F.col(label))
    counts = rows.where(F.col(prediction) > 0).groupBy(c.alias("threshold")).agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fp"))
    whole = rows.agg(F.count_if(F.col(label) > 0).alias("positives"), F.count(F.lit(1)).alias("rows"))
    swept = _sweep(counts, ["tp", "fp"]).crossJoin(F.broadcast(whole))
    scored = swept.withColumn("f1", F.coalesce(ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives")), F.lit(0.0))).where("f1 > 0")
    best = scored.agg(F.max(F.struct("f1", "threshold")).alias("b"))
    return best.crossJoin(F.broadcast(whole)).select(F.when(F.col("rows") == 0, 0.5).otherwise(F.coalesce("b.threshold", F.lit(1.0))).alias("threshold"), F.coalesce("b.f1", F.lit(0.0)).alias("f1"))


def best_coverage_threshold(rows: DataFrame, confidence: str, correct: str, coverage: float = 0.90) -> DataFrame:
    """(threshold, accuracy, coverage): most accurate threshold that keeps ``coverage`` of the rows."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence)))
    counts = rows.groupBy(c.alias("threshold")).agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col(correct)).alias("right"))
    whole = rows.agg(F.count(F.lit(1)).alias("all"))
    s = _sweep(counts, ["kept", "right"]).crossJoin(F.broadcast(whole)).withColumns({"coverage": ratio(F.col("kept"), F.col("all")), "accuracy": ratio(F.col("right"), F.col("kept"))})
    best = s.where(F.col("coverage") + EPS >= coverage).agg(F.max(F.struct("accuracy", "threshold", "coverage")).alias("b"))
    return best.crossJoin(F.broadcast(whole)).select(F.when(F.col("all") == 0, 0.5).otherwise(F.coalesce("b.threshold", F.lit(0.0))).alias("threshold"), F.col("b.accuracy").alias("accuracy"), F.col("b.coverage").alias("coverage"))


def contingency(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(table: DataFrame) -> DataFrame:
    """Per class support, predicted, tp, precision, recall, F1 from a contingency table."""
    sides = table.select(F.explode(F.array(F.struct(F.col("truth").alias("cls"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("tp")))).alias("s"))
    g = sides.groupBy("s.cls").agg(F.sum("s.t").alias("support"), F.sum("s.p").alias("predicted"), F.sum("s.tp").alias("tp"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return g.withColumns({"precision": z(ratio(F.col("tp"), F.col("predicted"))), "recall": z(ratio(F.col("tp"), F.col("support"))), "f1": f1(F.col("tp"), F.col("predicted"), F.col("support"))})


def clustering_scores(table: DataFrame) -> DataFrame:
    """Purity, adjusted Rand, mutual information, homogeneity, completeness, V from a contingency table."""
    pairs = lambda c: c * (c - 1) / 2
    n = table.agg(F.sum("n").cast("double").alias("total"))
    cells = table.agg(F.sum(pairs(F.col("n"))).alias("ij"))
    rows = table.groupBy("truth").agg(F.sum("n").cast("double").alias("a"))
    cols = table.groupBy("predicted").agg(F.sum("n").cast("double").alias("b"), F.max("n").alias("top"))
    ra, cb = rows.agg(F.sum(pairs(F.col("a"))).alias("sa")), cols.agg(F.sum(pairs(F.col("b"))).alias("sb"), F.sum("top").alias("tops"))
    one = reduce(lambda x, y: x.crossJoin(F.broadcast(y)), [cells, ra, cb, n])
    ent = lambda d, c: d.crossJoin(F.broadcast(n)).agg(F.sum(-F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total"))).alias(f"h_{c}"))
    mi = table.join(rows, "truth").join(cols, "predicted").crossJoin(F.broadcast(n)).agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("a") * F.col("b")))).alias("mi"))
    one = reduce(lambda x, y: x.crossJoin(F.broadcast(y)), [one, ent(rows, "a"), ent(cols, "b"), mi])
    expected = F.col("sa") * F.col("sb") / pairs(F.col("total"))
    hom = F.when(F.col("h_a") > 0, F.col("mi") / F.col("h_a")).otherwise(1.0)
    com = F.when(F.col("h_b") > 0, F.col("mi") / F.col("h_b")).otherwise(1.0)
    return one.select(
        (F.col("tops") / F.col("total")).alias("purity"), F.coalesce(F.try_divide(F.col("ij") - expected, (F.col("sa") + F.col("sb")) / 2 - expected), F.lit(1.0)).alias("adjusted_rand"),
        F.col("mi").alias("mutual_information"), hom.alias("homogeneity"), com.alias("completeness"), F.coalesce(F.try_divide(2 * hom * com, hom + com), F.lit(0.0)).alias("v_measure"),
        F.coalesce(F.try_divide(F.col("mi"), (F.col("h_a") + F.col("h_b")) / 2), F.lit(1.0)).alias("normalized_mutual_information"),
    )


def best_mapping(table: DataFrame, k: int) -> DataFrame:
    """(predicted, truth): the one-to-one mapping of k clusters 0..k-1 to k classes 0..k-1 that keeps most rows.

    The k x k table (its size is that of the labels, not of the data) is solved
    as an assignment; of equals the mapping that is first in order is taken,
    for which every cell gets a bonus too small to outweigh a row.
    """
    from folioflow.operators.drift import assign

    counts = {(r["predicted"], r["truth"]): r["n"] for r in table.where(F.col("predicted").between(0, k - 1) & F.col("truth").between(0, k - 1)).collect()}  # at most k * k rows
    # row i, column j: weights are whole numbers; the bonus reads the mapping as digits in base k
    weight = [[counts.get((i, j), 0) * (k ** (k + 1)) + (k - 1 - j) * k ** (k - 1 - i) for j in range(k)] for i in range(k)]
    return table.sparkSession.createDataFrame(assign(weight), "predicted int, truth int")


def inverse_sqrt_weights(counts: DataFrame, cls: str, n: str) -> DataFrame:
    """Class weights sqrt(all / (classes * n)) within [0.25, 4], scaled to mean 1; 0 for absent classes."""
    whole = counts.agg(F.sum(n).alias("_all"), F.count_if(F.col(n) > 0).alias("_k"))
    raw = F.when(F.col(n) > 0, F.greatest(F.lit(0.25), F.least(F.lit(4.0), F.sqrt(F.col("_all") / (F.col("_k") * F.col(n)))))).otherwise(0.0)
    w = counts.crossJoin(F.broadcast(whole)).withColumn("_raw", raw)
    mean = w.where("_raw > 0").agg(F.avg("_raw").alias("_mean"))
    return w.crossJoin(F.broadcast(mean)).select(cls, n, (F.col("_raw") / F.col("_mean")).alias("weight"))


# --- angles -------------------------------------------------------------------
def normalize_angle(a: Column) -> Column:
    """Into [0, 360), values within 1e-10 of a full turn at 0; NULL where not finite."""
    m = F.pmod(a, F.lit(360.0))
    out = F.when((F.abs(m) < 1e-10) | (F.abs(m - 360.0) < 1e-10), 0.0).otherwise(m)
    return F.when(F.isnan(a) | (F.abs(a) == float("inf")), None).otherwise(out)


def rotation_zone(a: Column) -> Column:
    return F.least(F.lit(4), F.floor(normalize_angle(a) / 90.0) + 1).cast("int")


def circular_error(a: Column, b: Column) -> Column:
    d = F.abs(normalize_angle(a) - normalize_angle(b))
    return F.least(d, 360.0 - d)


def signed_correction(a: Column) -> Column:
    return -normalize_angle(a)


def angle_summary(rows: DataFrame, by: list[str], error: str, tolerances: tuple[float, ...] = (1.0, 2.0, 5.0, 10.0)) -> DataFrame:
    e = F.col(error)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempted"), F.count(error).alias("estimated"), F.avg(e).alias("mean_error"), F.median(e).alias("median_error"), F.stddev_pop(e).alias("std_error"), F.sqrt(F.avg(e * e)).alias("rms_error"), F.max(e).alias("max_error"),
        *[ratio(F.count_if(e <= t), F.count(error)).alias(f"within_{int(t)}") for t in tolerances],
    )


def weighted_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The first value at which half of the weight is reached; negative weights count nothing."""
    w = F.greatest(F.lit(0.0), F.col(weight))
    g = rows.groupBy(*by, F.col(value).alias("_v")).agg(F.sum(w).alias("_w"))
    win = W.partitionBy(*by).orderBy("_v")
    c = g.withColumn("_cum", F.sum("_w").over(win.rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_w").over(W.partitionBy(*by)))
    return c.where(F.col("_cum") >= F.col("_all") / 2 - 1e-9).groupBy(*by).agg(F.min("_v").alias("weighted_median"))


# --- temperature --------------------------------------------------------------
def temperature_losses(rows: DataFrame, logits: str, label: str, temperatures: list[float]) -> DataFrame:
    """(temperature, nll): mean negative log-likelihood of each temperature in one pass."""
    t = F.explode(F.array(*[F.lit(x) for x in temperatures]))
    each = rows.select(logits, label, t.alias("temperature"))
    scaled = F.transform(F.col(logits), lambda x: x / F.col("temperature"))
    top = F.array_max(scaled)
    lse = top + F.log(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return each.select("temperature", (lse - F.element_at(scaled, F.col(label) + 1)).alias("l")).groupBy("temperature").agg(F.avg("l").alias("nll"))


def fit_temperature(rows: DataFrame, logits: str, label: str) -> float:
    """Two-stage grid: 21 log-spaced in [0.25, 4], then 11 evenly spaced around the best."""
    grid = [10 ** (math.log10(0.25) + i * (math.log10(4) - math.log10(0.25)) / 20) for i in range(21)]

    def best(ts: list[float]) -> float:
        return temperature_losses(rows, logits, label, ts).agg(F.min_by("temperature", F.struct("nll", "temperature"))).first()[0]

    b = best(grid)
    i = min(range(21), key=lambda j: abs(grid[j] - b))
    lo, hi = grid[max(0, i - 1)], grid[min(20, i + 1)]
    return best([lo + j * (hi - lo) / 10 for j in range(11)])


# --- composite scores and gates -------------------------------------------------
# Weights of the selection scores; a minus marks a metric that counts as 1 - value.
SCORES = {
    "ocr_model": {"detection_f1": 0.20, "coverage": 0.15, "-wer": 0.10, "critical_exact": 0.15, "entity_f1": 0.15, "canonical_accuracy": 0.10, "relation_f1": 0.05, "efficiency": 0.05, "-failure_rate": 0.05},
    "preprocessing": {"detection_f1": 0.30, "coverage": 0.25, "-wer": 0.15, "critical_exact": 0.20, "efficiency": 0.10},
    "recognizer": {"-cer": 0.25, "-wer": 0.20, "amount_exact": 0.20, "identifier_exact": 0.15, "date_exact": 0.10, "currency_exact": 0.05, "turkish_accuracy": 0.05},
    "padding": {"critical_exact": 0.40, "coverage": 0.20, "-wer": 0.15, "entity_f1": 0.10, "canonical_accuracy": 0.05, "efficiency": 0.05, "-failure_rate": 0.05},
    "downstream": {"reference_entity_f1": 0.25, "real_entity_f1": 0.20, "evidence_f1": 0.15, "critical_exact": 0.15, "relation_f1": 0.10, "rotated_entity_f1": 0.10, "document_f1": 0.05},
}


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))


def selection_score(name: str) -> Column:
    parts = [(1.0 - clamp(F.col(m[1:]))) * w if m[0] == "-" else clamp(F.col(m)) * w for m, w in SCORES[name].items()]
    return reduce(lambda a, b: a + b, parts)


def strict_score(name: str) -> Column:
    """The score, an error where a metric is missing or outside [0, 1]."""
    bad = reduce(lambda a, b: a | b, [F.col(m).isNull() | F.isnan(m) | ~F.col(m).between(0, 1) for m in SCORES[name]])
    return F.when(bad, F.raise_error(F.lit("selection metrics must be in [0, 1]")).cast("double")).otherwise(selection_score(name))


# Names of the criteria of both gates, and of the checks that a trial has to have passed.
RECOGNIZER_CHECKS = ("confidence_finite", "export_reload_passed", "dictionary_match_passed")
DETECTOR_CHECKS = ("export_reload_passed", "adapter_contract_passed", "rotated_page_passed", "blank_low_text_passed")


def _passed(row: str, checks: tuple[str, ...]) -> dict[str, Column]:
    return {c: F.coalesce(F.col(f"{row}.{c}"), F.lit(False)) for c in checks} | {"no_private_data": F.col(f"{row}.private_rows") == 0}


def recognizer_gate(b: str, c: str, slowest: float, critical: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """The ten named criteria for replacing a recogniser (aliases of baseline and candidate rows).

    ``critical`` are the two rows' scores of exact critical fields, where they
    aren't columns ``critical_exact``.
    """
    v = lambda a, n: F.col(f"{a}.{n}")
    gain = F.when(v(b, "wer") > 0, (v(b, "wer") - v(c, "wer")) / v(b, "wer")).otherwise(0.0)
    keeps = lambda n, slack=0.0: clamp(v(c, n)) + slack + EPS >= clamp(v(b, n))
    was, now = critical or (v(b, "critical_exact"), v(c, "critical_exact"))
    return {
        "wer_improvement_or_floor": (gain >= 0.15 - EPS) | (v(c, "wer") <= 0.45 + EPS),
        "critical_field_exact_gain": now - was >= 0.10 - EPS,
        "numeric_and_amount_no_regression": keeps("numeric_exact") & keeps("amount_exact"),
        "english_no_material_regression": keeps("english_exact", 0.02),
        "turkish_valid": v(c, "turkish_accuracy").between(0, 1) & (v(c, "turkish_accuracy") + 0.02 + EPS >= v(b, "turkish_accuracy")),
        "processing_time_acceptable": v(c, "seconds") <= slowest,
        **_passed(c, RECOGNIZER_CHECKS),
    }


def detector_measures(b: str, c: str, slowest: float) -> dict[str, Column]:
    """The criteria for replacing a detector that compare figures of the two rows."""
    v = lambda a, n: F.col(f"{a}.{n}")
    return {
        "f1_improvement_or_floor": (v(c, "f1") - v(b, "f1") >= 0.10 - EPS) | (v(c, "f1") >= 0.60 - EPS),
        "critical_recall_no_regression": v(c, "critical_recall") + EPS >= v(b, "critical_recall"),
        "no_new_failures": F.coalesce(v(c, "failures"), F.lit(0)) == 0,
        "processing_time_acceptable": v(c, "seconds") <= slowest,
    }


def detector_gate(b: str, c: str, slowest: float) -> dict[str, Column]:
    """All nine criteria for replacing a detector: the figures, the checks passed and no private rows."""
    return {**detector_measures(b, c, slowest), **_passed(c, DETECTOR_CHECKS)}


def accepted(criteria: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in criteria.values()])


def simplest_material(rows: DataFrame, name: str, score: str, complexity: dict[str, int], baseline: str) -> DataFrame:
    """The baseline unless the best gains 0.02; else the simplest within 0.01 of the best."""
    rank = reduce(lambda acc, kv: F.when(F.col(name) == kv[0], kv[1]).otherwise(acc), complexity.items(), F.lit(99))
    best = rows.agg(F.max(score).alias("_best"), F.max(F.when(F.col(name) == baseline, F.col(score))).alias("_base"))
    s = rows.crossJoin(F.broadcast(best)).withColumn("_c", rank)
    stay = F.coalesce(F.col("_best") - F.col("_base") < 0.02, F.lit(False))
    ok = F.when(stay, F.col(name) == baseline).otherwise(F.col(score) + 0.01 >= F.col("_best"))
    return s.where(ok).orderBy("_c", F.desc(score), name).limit(1).select(name, score)


def retention(rows: DataFrame, by: list[str], angle: str, metric: str) -> DataFrame:
    """Each angle's metric as a share of the upright one; NULL where that is 0 or missing."""
    base = rows.where(F.col(angle) == 0).groupBy(*by).agg(F.max(metric).alias("_upright"))
    return rows.join(base, by, "left").withColumn("retention", F.when(F.col("_upright") > 0, F.col(metric) / F.col("_upright"))).drop("_upright")


def regressions(rows: DataFrame, baseline: DataFrame, metrics: list[str], slack: float = 0.02) -> DataFrame:
    """Rows with the metrics that fall more than ``slack`` below the single baseline row."""
    b = baseline.select(*[F.col(m).alias(f"_b_{m}") for m in metrics])
    worse = F.array_compact(F.array(*[F.when(F.col(m) + slack + EPS < F.col(f"_b_{m}"), F.lit(m)) for m in metrics]))
    return rows.crossJoin(F.broadcast(b)).withColumn("regressed", F.array_join(worse, ",")).withColumn("passed", F.size(worse) == 0).drop(*[f"_b_{m}" for m in metrics])


def metric_deltas(baseline: DataFrame, candidate: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    b, c = baseline.alias("b"), candidate.alias("c")
    return c.join(b, [F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in by]).select(*[F.col(f"c.{k}").alias(k) for k in by], *[(F.col(f"c.{m}") - F.col(f"b.{m}")).alias(f"{m}_delta") for m in metrics])
