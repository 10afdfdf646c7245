"""Annotation formats as tables of tokens, entities, relations, fields and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.functions.ids import stable_id
from folioflow.operators.extract import runs

# Field names of the sources and the words of questions.
CSV_FIELDS = {"company": "organization_name", "address": "address", "date": "date", "total": "total_amount"}
GRID_FIELDS = {
    "SELLER_NAME": "organization_name", "DATE": "date", "NUMBER": "invoice_number", "SUB_TOTAL": "subtotal", "TAX": "tax", "TOTAL": "total_amount", "SELLER_ADDRESS": "address",
    "SELLER_EMAIL": "email", "TITLE": "document_title",
}
QUESTIONS = (
    (("store name", "merchant", "company"), "organization_name"), (("invoice number",), "invoice_number"), (("receipt number", "transaction number"), "receipt_number"), (("reference number", "account number"), "reference_number"),
    (("due date", " date", "date?"), "date"), (("subtotal",), "subtotal"), (("tax", "vat"), "tax"), (("total", "amount due"), "total_amount"), (("address",), "address"), (("email",), "email"), (("phone", "telephone"), "phone_number"),
)
FORM = "form array<struct<id:int,label:string,text:string,box:array<double>,words:array<struct<text:string,box:array<double>>>,linking:array<array<int>>>>"
GRID = "words array<string>, bboxes array<array<double>>, ner_tags array<int>"
QA = "array<struct<question:string,answer:string>>"


def _valid(box: Column) -> Column:
    return (F.size(box) == 4) & (box[2] > box[0]) & (box[3] > box[1])


def csv_lines(pages: DataFrame, page: str, text: str) -> DataFrame:
    """Lines of eight coordinates and a text: (page, line_no, text, box, skipped).

    The text keeps its commas; ``skipped`` names why a line is no token.
    """
    rows = pages.select(page, F.posexplode(F.split(F.regexp_replace(text, "^﻿", ""), "\r?\n")).alias("i", "row")).where("trim(row) <> ''")
    parts = F.split("row", ",")
    xy = F.transform(F.slice(parts, 1, 8), lambda v: F.trim(v).try_cast("double"))
    said = F.trim(F.array_join(F.slice(parts, F.lit(9), F.greatest(F.lit(0), F.size(parts) - 8)), ","))
    xs, ys = F.filter(xy, lambda v, i: i % 2 == 0), F.filter(xy, lambda v, i: i % 2 == 1)
    box = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    why = F.when(F.size(parts) < 9, "fewer_than_9_values").when(F.exists(xy, lambda v: v.isNull()), "invalid_coordinate").when(said == "", "empty_text").when(~_valid(box), "degenerate_geometry")
    return rows.select(page, (F.col("i") + 1).alias("line_no"), F.when(why.isNull(), said).alias("text"), F.when(why.isNull(), box).alias("box"), why.alias("skipped"))


def form_entities(pages: DataFrame, page: str, content: str) -> DataFrame:
    """Entities of form JSON: (page, source_id, label, text, words, links)."""
    f = pages.select(page, F.posexplode(F.from_json(content, FORM)["form"]).alias("i", "f"))
    low = F.lower("f.label")
    label = F.when(low.isin("header", "question", "answer"), F.upper("f.label")).otherwise("OTHER")
    words = F.filter("f.words", lambda w: (F.trim(w.text) != "") & _valid(w.box))
    own = F.when((F.trim("f.text") != "") & _valid(F.col("f.box")), F.array(F.struct(F.col("f.text").alias("text"), F.col("f.box").alias("box")))).otherwise(F.array().cast("array<struct<text:string,box:array<double>>>"))
    used = F.when(F.size(words) > 0, words).otherwise(own)
    return f.select(page, F.coalesce("f.id", "i").alias("source_id"), label.alias("label"), F.coalesce(F.nullif("f.text", F.lit("")), F.array_join(F.transform(used, lambda w: w.text), " ")).alias("text"), used.alias("words"), F.col("f.linking").alias("links"))


def form_relations(entities: DataFrame, page: str) -> DataFrame:
    """Distinct links whose two ends are entities with words."""
    kept = entities.where(F.size("words") > 0)
    links = entities.select(page, F.explode("links").alias("l")).where("size(l) = 2").select(page, F.col("l")[0].alias("a"), F.col("l")[1].alias("b")).distinct()
    end = lambda n: kept.select(page, F.col("source_id").alias(n), F.col("label").alias(f"label_{n}"))
    j = links.join(end("a"), [page, "a"]).join(end("b"), [page, "b"])
    qa = F.array_sort(F.array("label_a", "label_b")) == F.array(F.lit("ANSWER"), F.lit("QUESTION"))
    return j.select(page, "a", "b", F.when(qa, "QUESTION_ANSWER").otherwise("GENERIC").alias("type"), stable_id("rel", F.col(page), F.col("a"), F.col("b")).alias("relation_id"))


def grid_tokens(pages: DataFrame, page: str, content: str, width: Column, height: Column) -> DataFrame:
    """Tokens of parallel arrays: (page, token_no, text, box, label, tag); unequal lengths give none."""
    g = pages.select(page, F.from_json(content, GRID).alias("g"), width.cast("double").alias("w"), height.cast("double").alias("h"))
    same = (F.size("g.words") == F.size("g.bboxes")) & (F.size("g.words") == F.size("g.ner_tags"))
    t = g.where(same).select(page, "w", "h", F.posexplode(F.arrays_zip("g.words", "g.bboxes", "g.ner_tags")).alias("token_no", "t"))
    b = F.col("t.bboxes")
    box = F.array(*[F.greatest(F.lit(0.0), F.least(F.col("w" if i % 2 == 0 else "h"), b[i])) for i in range(4)])
    label = F.when(F.col("t.ner_tags") == 10, "TABLE_CELL").when(F.col("t.ner_tags") == 13, "OTHER").otherwise("VALUE")
    return t.where((F.trim("t.words") != "") & _valid(b)).select(page, "token_no", F.trim("t.words").alias("text"), box.alias("box"), label.alias("label"), F.col("t.ner_tags").alias("tag")).where(_valid(F.col("box")))


def grid_entities(tokens: DataFrame, page: str) -> DataFrame:
    """Runs of equal tags as entities; runs labelled OTHER are none."""
    r = runs(tokens, [page], "token_no", "tag").alias("r")
    t = tokens.alias("t")
    j = t.join(r, (F.col(f"t.{page}") == F.col(f"r.{page}")) & F.col("t.token_no").between(F.col("r.first_at"), F.col("r.last_at"))).where("t.label <> 'OTHER'")
    return j.groupBy(F.col(f"t.{page}").alias(page), F.col("r.run_no").alias("run_no")).agg(F.first("t.label").alias("label"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t.token_no", "t.text"))), lambda s: s.text), " ").alias("text"))


def question_field(question: Column) -> Column:
    low = F.lower(question)
    out = F.lit(None).cast("string")
    for words, field in reversed(QUESTIONS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(field)).otherwise(out)
    return out


def question_fields(pages: DataFrame, page: str, content: str) -> DataFrame:
    """(page, field, value): the first answer for each field that a question asks for."""
    q = pages.select(page, F.posexplode(F.from_json(content, QA)).alias("i", "qa")).where("trim(qa.question) <> '' AND trim(qa.answer) <> ''")
    q = q.withColumn("field", question_field(F.col("qa.question"))).where("field IS NOT NULL")
    return q.groupBy(page, "field").agg(F.min_by(F.trim("qa.answer"), "i").alias("value"))


def named_fields(pages: DataFrame, page: str, content: str, names: dict[str, str]) -> DataFrame:
    """(page, field, value) of an object of names (or of objects with a text)."""
    m = pages.select(page, F.explode(F.from_json(content, "map<string,string>")).alias("k", "v"))
    text = F.coalesce(F.get_json_object("v", "$.text"), F.when(~F.startswith("v", F.lit("{")), F.col("v")))
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("k"))
    return m.select(page, mapped.alias("field"), text.alias("value")).where("field IS NOT NULL AND value <> ''")
