"""Document results, canonical JSON and keys, trials, candidates and reserves: one row each."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from folioflow.functions import text as X
from folioflow.functions.geometry import polygon_box
from folioflow.functions.ids import digest, stable_id
from folioflow.operators.metrics import EPS, ratio
from folioflow.operators.recognition import FIELD_GROUPS

# Version and canonical fields of a document result, in their order.
SCHEMA_VERSION = "1.0"
FIELDS = (
    "organization_name", "vendor_name", "customer_name", "person_name", "document_title", "website", "date", "time", "invoice_number", "receipt_number", "reference_number", "tax_identification_number",
    "customer_account_number", "subtotal", "discount", "service_charge", "tax", "total_amount", "paid_amount", "balance", "currency", "payment_method", "bank_name", "account_reference", "address", "email", "phone_number",
)
# The fields of a recognition cache key.
CACHE_KEY = (
    "input_sha256", "detector_model", "detector_artifact_hash", "recognizer_model", "recognizer_artifact_hash", "language_route_configuration", "orientation_configuration", "paddleocr_version", "preprocessing_version",
)
CRITICAL_FIELDS = tuple(sorted(f for names in FIELD_GROUPS.values() for f in names))


# --- canonical JSON and digests -------------------------------------------------
@F.pandas_udf(T.StringType())
def _escaped(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else re.sub(r"[^\x00-\x7f]", lambda m: json.dumps(m.group())[1:-1], t))


def canonical_json(values: dict[str, Column]) -> Column:
    """The values as JSON text: names sorted, no spaces, ASCII escapes, NaN and infinities as null.

    Values are texts, whole numbers, booleans, NULL or maps whose keys are
    sorted already; only rows with other than ASCII characters leave the JVM.
    """
    text = F.to_json(F.struct(*[values[n].alias(n) for n in sorted(values)]), {"ignoreNullFields": "false"})
    plain = ~text.rlike(r"[^\x00-\x7F]")
    return F.when(plain, text).otherwise(_escaped(F.when(~plain, text)))


def configuration_hash(values: dict[str, Column], length: int = 16) -> Column:
    return digest(canonical_json(values), length)


def cache_key(values: dict[str, Column]) -> Column:
    """Digest of the nine parts that decide a recognition result; a missing part is an error."""
    return configuration_hash({n: values[n] for n in CACHE_KEY}, 64)


def stack_binding(values: dict[str, Column], parts: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """One digest per part of a recognition stack, each over its own settings."""
    return {f"{name}_binding": configuration_hash({k: values[k] for k in keys}, 64) for name, keys in parts.items()}


def binding_mismatches(actual: str, expected: str, parts) -> Column:
    """Names of the parts whose digests differ or are missing, of two aliased rows."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(F.col(f"{actual}.{p}_binding") == F.col(f"{expected}.{p}_binding"), F.lit(False)), F.lit(p)) for p in parts]))


def evaluation_allowed(trained_profile: Column, profile: Column, trained_build: Column, build: Column, comparison_only: Column) -> Column:
    """Profile and build have to be those of the training, unless the run only compares builds."""
    same = trained_profile.eqNullSafe(profile)
    return same & (trained_build.eqNullSafe(build) | F.coalesce(comparison_only, F.lit(False)))


# --- results --------------------------------------------------------------------
def document_results(best: DataFrame, by: str) -> DataFrame:
    """One row per document: type, languages' place, and every canonical field, set or null, as JSON.

    ``best`` has one row per (document, field); a field that isn't canonical is
    an error.  ``broken`` lists what a valid result must have and this hasn't.
    """
    known = F.when(F.col("field").isin(*FIELDS), F.col("field")).otherwise(F.raise_error(F.lit("unsupported canonical field")).cast("string"))
    rows = best.select(by, known.alias("field"), "value", "confidence")
    wide = rows.groupBy(by).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS], F.count("value").alias("present"), F.min("confidence").alias("_low"), F.max("confidence").alias("_high"))
    label = F.coalesce("document_title", F.lit("unknown"))
    rules = {"document_id": F.col(by).isNotNull(), "document_type": label.isin("invoice", "receipt", "unknown"), "confidence": F.col("_low").between(0, 1) & F.col("_high").between(0, 1), "fields": F.col("present") > 0}
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
    fields = F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"})
    return wide.select(by, F.lit(SCHEMA_VERSION).alias("schema_version"), label.alias("document_type"), fields.alias("fields"), "present", F.array_join(broken, ",").alias("broken"))


def page_texts(lines: DataFrame, by: str, page: str, order: str, text: str) -> DataFrame:
    """(by, text): the pages of a document with a header each, lines in order; trimmed."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "\n")
    pages = lines.groupBy(by, page).agg(F.trim(line).alias("_t"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col("_t").alias("t")))), lambda s: F.concat(F.lit("--- Page "), s.p.cast("string"), F.lit(" ---\n"), s.t))
    return pages.groupBy(by).agg(F.trim(F.array_join(whole, "\n\n")).alias("text"))


def relation_counts(entities: DataFrame, relations: DataFrame, keys: list[str]) -> DataFrame:
    """Relations counted by type and by label and text of both ends; ends that are no entity are left out."""
    side = lambda a: entities.select(*keys, F.col("entity_id").alias(f"{a}_id"), F.col("label").alias(f"{a}_label"), X.folded(F.col("entity_text")).alias(f"{a}_text"))
    named = relations.join(side("source"), [*keys, "source_id"]).join(side("target"), [*keys, "target_id"])
    return named.groupBy(*keys, "relation_type", "source_label", "source_text", "target_label", "target_text").agg(F.count(F.lit(1)).alias("n"))


def token_fields(evidence: DataFrame, by: list[str], field: str) -> DataFrame:
    """Per token the critical fields that it is evidence for, sorted."""
    low = F.lower(field)
    return evidence.where(low.isin(*CRITICAL_FIELDS)).groupBy(*by).agg(F.sort_array(F.collect_set(low)).alias("fields"))


def transcription_fault(text: Column) -> Column:
    """Why a text is no transcription: empty, or with a tab or line break; NULL where it is one."""
    return F.when(text.isNull() | (F.trim(F.regexp_replace(text, r"\s+", " ")) == ""), "empty").when(text.rlike(r"[\t\r\n]"), "control")


# --- crops, tiles, angles -------------------------------------------------------
def candidate_records(rows: DataFrame, by: list[str], ordinal: str, text: str, confidence: str, thai: Column, pattern: str | None = None) -> DataFrame:
    """Every recognition candidate of a crop with its score and parts.

    The agreement is the share of the earlier candidates that say the same;
    without an expected pattern its part is a half.
    """
    t = F.col(text)
    same = W.partitionBy(*by, "_said").orderBy(ordinal)
    earlier = W.partitionBy(*by).orderBy(ordinal)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    script = F.length(F.regexp_replace(t, r"[^\p{L}]|[^\x{0E00}-\x{0E7F}]", "")) / F.greatest(F.lit(1), letters)
    parts = {
        "valid_ratio": F.length(F.regexp_replace(t, r"\p{C}", "")) / F.greatest(F.lit(1), F.length(t)), "script_consistency": F.when(thai, script).otherwise(1 - script),
        "pattern_score": F.lit(0.5) if pattern is None else t.rlike(pattern).cast("double"), "agreement": F.coalesce(ratio(F.row_number().over(same) - 1, F.nullif(F.row_number().over(earlier) - 1, F.lit(0))), F.lit(0.0)),
    }
    scored = rows.withColumn("_said", X.folded(t)).withColumns(parts).drop("_said")
    total = 0.55 * F.col(confidence) + 0.15 * F.col("valid_ratio") + 0.10 * F.col("script_consistency") + 0.15 * F.col("pattern_score") + 0.05 * F.col("agreement")
    return scored.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def retried(candidates: DataFrame, by: list[str], ordinal: str, confidence: str, least: float = 0.65) -> DataFrame:
    """The candidate taken per crop: the first if it is sure enough, else the best by score, confidence and earliness."""
    rest = [c for c in candidates.columns if c not in by]
    first = F.min_by(F.struct(*rest), F.col(ordinal))
    best = F.max_by(F.struct(*rest), F.struct("score", confidence, -F.col(ordinal)))
    g = candidates.groupBy(*by).agg(first.alias("_f"), best.alias("_b"))
    sure = F.col(f"_f.{confidence}") >= least
    return g.select(*by, F.when(sure, F.col("_f")).otherwise(F.col("_b")).alias("_c"), (~sure).alias("retried")).select(*by, "_c.*", "retried")


def tile_to_page(words: DataFrame, tile: str, ordinal: str, text: str, polygon: str, scale: Column) -> DataFrame:
    """Words of a tile in the page's coordinates, with new ids; fewer than four corners are left out.

    ``tile`` is a struct with tile, x0 and y0.
    """
    moved = F.transform(polygon, lambda p: F.array(F.col(f"{tile}.x0") + p[0] / scale, F.col(f"{tile}.y0") + p[1] / scale))
    out = words.where(F.size(polygon) >= 4).withColumn("polygon", moved).withColumn("bbox", polygon_box(F.col("polygon")))
    return out.withColumn("id", stable_id("tile-word", F.col(f"{tile}.tile"), F.col(ordinal), F.col(text), F.array_join(F.transform("bbox", lambda v: v.cast("decimal(20,4)").cast("string")), ",")))


def restored(polygon: Column, width: Column, height: Column) -> Column:
    """A polygon that was mapped back to its page, kept within it."""
    low = lambda v, most: F.greatest(F.lit(0.0), F.least(most.cast("double"), v))
    return F.transform(polygon, lambda p: F.array(low(p[0], width), low(p[1], height)))


def line_alignment(words: DataFrame, by: str) -> DataFrame:
    """1 less the median slope of the words' upper edges in right angles; 0 without words."""
    dx, dy = F.col("p1")[0] - F.col("p0")[0], F.col("p1")[1] - F.col("p0")[1]
    return words.groupBy(by).agg(F.coalesce(F.greatest(F.lit(0.0), 1 - F.median(F.abs(F.atan2(dy, dx))) / (F.lit(3.141592653589793) / 2)), F.lit(0.0)).alias("line_alignment"))


def seeded_angle(key: Column, epoch: Column, upright: float, angles: list[float], seed: str = "42") -> Column:
    """The angle of an example in an epoch: 0 for the share ``upright``, else one of ``angles``, by the digest of both."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), key.cast("string"), epoch.cast("string")), 256)
    part = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")
    pick = F.element_at(F.array(*[F.lit(float(a)) for a in angles]), (F.pmod(part(9), F.lit(len(angles))) + 1).cast("int"))
    return F.when(part(1) / F.lit(4294967296.0) < upright, 0.0).otherwise(pick)


def angle_grid(low: Column, high: Column, step: float) -> Column:
    """Angles from ``low`` on in steps, below ``high``; none where ``high`` is lower."""
    n = F.floor((high - min(step * 1e-5, 1e-6) - low) / step)
    return F.when(high < low, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), n)), lambda i: low + i * step))


def separated_runner_up(rows: DataFrame, by: list[str], angle: str, score: str, step: float) -> DataFrame:
    """Best candidate and the best one outside its window (four steps, one degree at least); else the second, else the best."""
    apart = max(1.0, 4.0 * step)
    w = W.partitionBy(*by).orderBy(F.desc(score), angle)
    r = rows.select(*by, angle, score, F.row_number().over(w).alias("_r"), F.first(angle).over(w).alias("_top"))
    far = (F.abs(F.col(angle) - F.col("_top")) >= apart) & (F.col("_r") > 1)
    own = F.struct(F.col(angle).alias("a"), F.col(score).alias("s"))
    g = r.groupBy(*by).agg(F.min_by(own, F.when(far, F.col("_r"))).alias("_far"), F.min_by(own, F.when(F.col("_r") > 1, F.col("_r"))).alias("_second"), F.min_by(own, "_r").alias("_best"))
    up = F.coalesce("_far", "_second", "_best")
    return g.select(*by, F.col("_best.a").alias("best_angle"), F.col("_best.s").alias("best_score"), up.a.alias("runner_up_angle"), up.s.alias("runner_up_score"))


def boundary_errors(rows: DataFrame, by: list[str], zone: Column, predicted: Column, near: Column) -> DataFrame:
    """Rows near a zone's boundary and away from it, and how many fall into a neighbouring zone (1 or 3 apart)."""
    apart = F.abs(zone - predicted)
    return rows.groupBy(*by, F.when(near, "boundary").otherwise("interior").alias("region")).agg(F.count(F.lit(1)).alias("n"), F.count_if(zone == predicted).alias("right"), F.count_if(apart.isin(1, 3)).alias("neighbouring"), F.count_if(apart == 2).alias("opposite"))


# --- trials and reserves --------------------------------------------------------
EXACTS = ("amount_exact", "date_exact", "identifier_exact", "currency_exact", "email_exact")


def critical_exact_score(row: str) -> Column:
    """Mean of the exact-match metrics that the row has; 0 without any."""
    have = F.filter(F.array(*[F.col(f"{row}.{m}").cast("double") for m in EXACTS]), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ratio(F.aggregate(have, F.lit(0.0), lambda a, x: a + x), F.nullif(F.size(have), F.lit(0))), F.lit(0.0))


def best_allowed(rows: DataFrame, by: list[str], selected: Column, eligible: Column) -> DataFrame:
    """Per group whether exactly one trial is selected and it is eligible, and why not."""
    g = rows.groupBy(*by).agg(F.count_if(selected).alias("selected"), F.count_if(selected & eligible).alias("eligible"))
    return g.withColumn("fault", F.when(F.col("selected") == 0, "none_selected").when(F.col("selected") > 1, "several_selected").when(F.col("eligible") == 0, "not_eligible"))


def error_ranking(errors: DataFrame, count: str, samples: str, impact: Column, feasibility: Column) -> DataFrame:
    """Errors with their frequency per sample and priority, frequency x impact x feasibility."""
    freq = F.coalesce(ratio(F.col(count), F.nullif(F.col(samples), F.lit(0))), F.lit(0.0))
    return errors.withColumns({"frequency": freq, "priority": freq * impact * feasibility})


def storage_reserve(free: Column, planned: Column, reserve: Column) -> dict[str, Column]:
    """What is left after what is planned, and whether it keeps the reserve; NULL sizes don't."""
    left = free - planned
    return {"left_after": left, "keeps_reserve": F.coalesce(left + EPS >= reserve, F.lit(False))}


def selective_accuracy(rows: DataFrame, by: list[str], confidence: str, right: Column, threshold: float) -> DataFrame:
    """Coverage and accuracy of the rows that are sure enough, and mean log loss of their confidence."""
    kept = F.col(confidence) >= threshold
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1.0), F.when(right, F.col(confidence)).otherwise(1 - F.col(confidence))))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ratio(F.count_if(kept), F.count(F.lit(1))).alias("coverage"), F.coalesce(ratio(F.count_if(kept & right), F.nullif(F.count_if(kept), F.lit(0))), F.lit(0.0)).alias("selective_accuracy"), F.avg(-F.log(p)).alias("nll"))


def mentioned(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(name, texts): names that occur in texts, letter case aside.  ``names`` is a short fixed list, sent to every task."""
    hit = F.contains(F.lower(F.col(text)), F.lower(F.col(name)))
    return texts.select(key, text).join(F.broadcast(names.where(F.length(name) > 0).select(name).distinct()), hit).groupBy(name).agg(F.count_distinct(key).alias("texts"))
