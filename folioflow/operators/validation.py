"""Constraints, envelopes, redaction and review: rows in, violations or safe rows out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.functions.text import contains_any, contains_thai

# Patterns and words of the provenance, secret and stratum tests.
SHA = "^[0-9a-f]{64}$"
COMMIT = "^[0-9a-f]{7,40}$"
SECRET = r"(?i)(?:api[_-]?key|secret|password|access[_-]?token)\s*[:=]\s*['\"][A-Za-z0-9_\-/.+=]{16,}"
AMOUNT = r"(?i)(?:total|subtotal|tax|vat|amount|thb|usd|eur|gbp|[$€£฿¥]).{0,24}[-+]?\d[\d.,]*"
DATE = r"\b(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})\b"
IDENTIFIER = r"(?i)\b(?:invoice|receipt|reference|ref|inv|tax\s*id)(?:\s*(?:no\.?|number|#|:))?\s*[A-Z0-9][A-Z0-9/-]{3,}\b"
CRITICAL = ("invoice", "receipt", "total", "amount", "date", "tax", "fatura")


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that don't hold, in order; a rule that is NULL doesn't hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def reasons(tests: dict[str, Column]) -> Column:
    """Names of the tests that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in tests.items()]))


def first_reason(tests: dict[str, Column]) -> Column:
    return F.try_element_at(reasons(tests), F.lit(1))


def require_empty(bad: DataFrame, what: str) -> DataFrame:
    """``bad`` itself; reading a row of it is an error that names ``what``."""
    return bad.where(F.raise_error(F.lit(what)).cast("boolean"))


def report_rules() -> dict[str, Column]:
    """Provenance rules of a metric report row."""
    c = F.col
    sha = lambda n: F.lower(c(n)).rlike(SHA)
    return {
        "build_id": F.trim("build_id") != "", "split": c("split").isin("train", "dev_select", "dev_calibration", "test_in_domain", "private_operational", "private_test"),
        "manifest_sha256": sha("manifest_sha256"), "checkpoint_sha256": c("checkpoint_sha256").isNull() | sha("checkpoint_sha256"), "source_commit": F.lower("source_commit").rlike(COMMIT),
        "sample_count": c("sample_count") >= 0, "failure_count": c("failure_count").between(0, c("sample_count")), "duration_seconds": c("duration_seconds") >= 0,
        "private_row_count": (c("private_row_count") == 0) | c("split").isin("private_operational", "private_test"),
    }


def single_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, values) of columns that should hold one value and hold several or none."""
    counted = rows.agg(*[F.count_distinct(c).alias(c) for c in columns])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("values")) for c in columns])).alias("r")).select("r.*").where("values <> 1")


def foreign_keys(child: DataFrame, key: list[str], parent: DataFrame, parent_key: list[str]) -> DataFrame:
    """Child rows whose key no parent has."""
    on = [F.col(f"c.{a}") == F.col(f"p.{b}") for a, b in zip(key, parent_key)]
    return child.alias("c").join(parent.select(*parent_key).distinct().alias("p"), on, "left_anti")


def public_only(private: Column, value: Column) -> Column:
    """``value``; an error unless the row says that it isn't private (NULL counts as private)."""
    return F.when(F.coalesce(private, F.lit(True)), F.raise_error(F.lit("a private row where only public ones are allowed"))).otherwise(value)


def redact(text: Column, names: list[str], stem: str | None = None, mark: str = "<private>") -> Column:
    """Names replaced, the longest first; the stem only where no letter or digit adjoins."""
    out = text
    for n in sorted({x for x in names if x and x != stem}, key=lambda x: (-len(x), x)):
        out = F.replace(out, F.lit(n), F.lit(mark))
    return out if not stem else F.regexp_replace(out, r"(?<![A-Za-z0-9])\Q" + stem + r"\E(?![A-Za-z0-9])", mark)


def review_rows(documents: DataFrame, key: str, fields: str) -> DataFrame:
    """One row per non-null field for review, sorted by name; ``fields`` is a map to (value, confidence)."""
    e = documents.select(key, F.explode(F.map_entries(fields)).alias("e")).where("e.value.value IS NOT NULL")
    return e.select(key, F.col("e.key").alias("field"), F.col("e.value.value").alias("value"), F.round("e.value.confidence", 4).alias("confidence"), F.lit("").alias("correct_value"), F.lit("").alias("note"))


def review_payload(documents: DataFrame, key: str, fields: str, text: str, selected: list[str], with_text: bool, most: int = 4000) -> DataFrame:
    """Only the selected fields, and of the text at most ``most`` characters, if at all."""
    most = min(most, 4000)
    return documents.select(key, F.map_filter(fields, lambda k, v: k.isin(*selected)).alias("fields"), (F.substring(text, 1, most) if with_text else F.lit(None).cast("string")).alias("text"))


def allowed_roles(rows: DataFrame, role: str, roles: list[str]) -> DataFrame:
    return rows.where(~F.coalesce(F.col(role).isin(*roles), F.lit(False)))


def family_roles(rows: DataFrame, family: str, role: str) -> DataFrame:
    """Families that appear in more than one role."""
    return rows.where(F.col(family).isNotNull()).groupBy(family).agg(F.count_distinct(role).alias("roles")).where("roles > 1")


def bucket(value: Column, low: float, high: float) -> Column:
    return F.when(value < low, "low").when(value < high, "medium").otherwise("high")


def text_strata(text: Column) -> dict[str, Column]:
    """Strata that a text puts its page in."""
    return {"has_amount": text.rlike(AMOUNT), "has_date": text.rlike(DATE), "has_identifier": text.rlike(IDENTIFIER), "has_thai": contains_thai(text), "critical_expected": contains_any(F.lower(text), CRITICAL)}


def quality_signals(lines: DataFrame, by: str, width: float = 1000.0, height: float = 1400.0) -> DataFrame:
    """Per page: boxes, median height, coverage, confidences and characters."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return lines.groupBy(by).agg(
        F.count(F.lit(1)).alias("box_count"), (F.median(F.col("y1") - F.col("y0")) / height).alias("height_ratio"), F.least(F.lit(1.0), F.sum(area) / (width * height)).alias("coverage"), F.avg("confidence").alias("mean_confidence"),
        F.median("confidence").alias("median_confidence"), F.sum(F.length(F.regexp_replace("text", r"\s+", ""))).alias("characters"), F.max(contains_any(F.lower("text"), CRITICAL)).alias("critical_found"),
    )


def rerender_reasons(height: float = 0.008, boxes: int = 3, coverage: float = 0.0015, confidence: float = 0.5, characters: int = 20, sparse: int = 8) -> Column:
    c = F.col
    return reasons({
        "tiny_median_text_height": c("height_ratio") < height, "suspiciously_few_text_boxes": c("box_count") < boxes, "low_text_coverage": c("coverage") < coverage,
        "low_recognition_confidence": (c("mean_confidence") < confidence) | (c("median_confidence") < confidence), "unusually_short_ocr_text": c("characters") < characters, "critical_text_missing": ~c("critical_found"),
    })


def tiling_reasons(largest: Column, least: int = 700) -> Column:
    c = F.col
    r = reasons({"weak_full_page_box_count": c("box_count") < 3, "weak_full_page_coverage": c("coverage") < 0.0015, "small_text": c("height_ratio") < 0.007, "low_full_page_confidence": c("mean_confidence") < 0.50})
    return F.when(largest >= least, r).otherwise(F.array().cast("array<string>"))


def candidate_score(words: DataFrame, by: str, width: float = 1000.0, height: float = 1400.0, centre: float = 0.75, scale: float = 0.20, thai: bool = False, alignment: DataFrame | None = None) -> DataFrame:
    """Score of a page's recognition in [0, 1] with its parts, from word rows.

    ``thai`` tells the route: script consistency is the share of Thai letters
    there and that of all others elsewhere.  ``alignment`` has ``line_alignment``
    per page (see :func:`records.line_alignment`); without it boxes are upright.
    """
    from folioflow.functions.text import garbage

    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    said = F.lower(F.trim("text"))
    thai_letters = F.length(F.regexp_replace("text", r"[^\x{0E00}-\x{0E7F}]", ""))
    script = F.length(F.regexp_replace("text", r"[^\p{L}\x{0E00}-\x{0E7F}]", ""))
    printable = F.length(F.regexp_replace("text", r"\p{C}", ""))
    same = words.groupBy(by, said.alias("_said")).agg(F.count(F.lit(1)).alias("_n")).groupBy(by).agg(F.sum(F.col("_n") - 1).alias("repeats"))
    g = words.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean"), F.median("confidence").alias("median"), F.sum(area).alias("area"), F.sum(thai_letters).alias("thai"), F.sum(script).alias("script"), F.sum(printable).alias("printable"),
        F.sum(F.length("text")).alias("chars"), F.count_if(garbage(F.col("text"))).alias("bad"), F.count_if(F.col("confidence") < 0.25).alias("low"),
    ).join(same, by)
    n, one = F.col("n"), F.lit(1.0)
    parts = {
        "word_count_score": F.least(one, F.log1p("n") / F.log(F.lit(41.0))), "calibrated_confidence": 1 / (1 + F.exp(-(F.col("mean") - centre) / scale)), "median_confidence": F.col("median"), "coverage": F.least(one, F.col("area") / (width * height)),
        "valid_ratio": F.col("printable") / F.greatest(F.lit(1), F.col("chars")), "script_consistency": F.col("thai") / F.greatest(F.lit(1), F.col("script")) if thai else 1 - F.col("thai") / F.greatest(F.lit(1), F.col("script")), "duplicate_penalty": F.col("repeats") / n, "garbage_penalty": F.col("bad") / n, "outlier_penalty": F.col("low") / n,
    }
    w = {"word_count_score": 0.22, "calibrated_confidence": 0.22, "median_confidence": 0.08, "valid_ratio": 0.13, "script_consistency": 0.10, "duplicate_penalty": -0.025, "garbage_penalty": -0.025, "outlier_penalty": -0.025}
    g = g.withColumn("line_alignment", F.lit(1.0)) if alignment is None else g.join(alignment.select(by, "line_alignment"), by, "left").fillna(0.0, ["line_alignment"])
    total = reduce(lambda a, b: a + b, [parts[k] * v for k, v in w.items()]) + 0.10 * F.least(one, parts["coverage"] * 8) + 0.10 * F.col("line_alignment")
    return g.select(by, F.greatest(F.lit(0.0), F.least(one, total)).alias("total"), *[v.alias(k) for k, v in parts.items()])


def secret_lines(lines: DataFrame, text: str) -> DataFrame:
    return lines.where(F.col(text).rlike(SECRET))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row by ``order`` per key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def derive(rows: DataFrame, new_id: Column, step: str) -> DataFrame:
    """Child rows that inherit a record's identity and add a step to its lineage."""
    return rows.withColumn("parent_sample_id", F.col("sample_id")).withColumn("sample_id", new_id).withColumn("transformations", F.array_append("transformations", F.lit(step)))


def schedule(pages: DataFrame, split: str, angles: dict[str, list[float]]) -> DataFrame:
    """Every page with each angle of its split's profile."""
    out = F.array().cast("array<double>")
    for s, values in angles.items():
        out = F.when(F.col(split) == s, F.array(*[F.lit(float(a)) for a in values])).otherwise(out)
    return pages.withColumn("angle", F.explode(out))
