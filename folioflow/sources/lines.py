"""Lines of text with place and confidence, from documents and from orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioflow.functions.ids import rank_key
from folioflow.sources.tables import table


def evidence(lines: DataFrame, *parts: str) -> DataFrame:
    """Adds bbox (x0, y0, x1, y1) and a confidence drawn from the hash of ``parts``."""
    key = F.concat_ws("|", *[F.col(p).cast("string") for p in parts])
    conf = F.conv(F.substring(rank_key(key), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    y = F.col("line_no") * F.lit(20.0)
    return lines.withColumns({"x0": F.lit(0.0), "y0": y, "x1": F.length("text") * F.lit(8.0), "y1": y + 16.0, "confidence": conf})


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document that isn't blank, numbered from 0 by its place."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    d = d.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").withColumn("page_number", F.lit(1))
    return evidence(d, "doc_id", "line_no")


def _amount(c: Column) -> Column:
    return F.concat(F.coalesce(c.cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)")).cast("string"), F.lit(" USD"))


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice of eight lines per order, its amounts from the order's items."""
    price, rate, tax = (F.col(c).cast("decimal(12,2)") for c in ("l_extendedprice", "l_discount", "l_tax"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(price).alias("sub"), F.sum(price * rate).alias("disc"), F.sum(price * (F.lit(1).cast("decimal(12,2)") - rate) * tax).alias("tax")
    )
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    date = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    text = F.array(
        F.upper("c_name"), F.concat(F.lit("Invoice No: INV-"), F.col("o_orderkey").cast("string")), F.concat(F.lit("Date: "), date),
        F.concat(F.lit("Subtotal: "), _amount(F.col("sub"))), F.concat(F.lit("Discount: "), _amount(F.round("disc", 2))),
        F.concat(F.lit("Tax: "), _amount(F.round("tax", 2))), F.concat(F.lit("Total: "), _amount(F.col("o_totalprice"))), F.concat(F.lit("Customer: "), F.col("c_name")),
    )
    lines = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), F.posexplode(text).alias("line_no", "text"))
    return evidence(lines, "doc_id", "line_no")


CONFIDENCE_SQL = "(('0x' || substr(sha256('42|' || doc_id || '|' || line_no), 1, 8))::UBIGINT::DOUBLE / 4294967295.0)"
INVOICE_SQL = f"""items AS (
    SELECT l_orderkey, sum(l_extendedprice::DECIMAL(12,2)) AS sub, sum(l_extendedprice::DECIMAL(12,2) * l_discount::DECIMAL(12,2)) AS disc,
           sum(l_extendedprice::DECIMAL(12,2) * (1::DECIMAL(12,2) - l_discount::DECIMAL(12,2)) * l_tax::DECIMAL(12,2)) AS tax FROM lineitem GROUP BY 1),
  o AS (SELECT o_orderkey AS doc_id, c_name, o_totalprice, coalesce(sub, 0) AS sub, coalesce(disc, 0) AS disc, coalesce(tax, 0) AS tax,
           CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day
        FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN items ON l_orderkey = o_orderkey),
  raw AS (SELECT doc_id, 0 AS line_no, upper(c_name) AS text FROM o
    UNION ALL SELECT doc_id, 1, 'Invoice No: INV-' || doc_id FROM o UNION ALL SELECT doc_id, 2, 'Date: ' || day FROM o
    UNION ALL SELECT doc_id, 3, 'Subtotal: ' || sub::DECIMAL(20,2) || ' USD' FROM o UNION ALL SELECT doc_id, 4, 'Discount: ' || round(disc, 2)::DECIMAL(20,2) || ' USD' FROM o
    UNION ALL SELECT doc_id, 5, 'Tax: ' || round(tax, 2)::DECIMAL(20,2) || ' USD' FROM o UNION ALL SELECT doc_id, 6, 'Total: ' || o_totalprice::DECIMAL(20,2) || ' USD' FROM o
    UNION ALL SELECT doc_id, 7, 'Customer: ' || c_name FROM o),
  lines AS (SELECT doc_id, line_no, text, {CONFIDENCE_SQL} AS confidence FROM raw)"""
DOCUMENT_SQL = rf"""raw AS (SELECT doc_id, unnest(generate_series(0, len(parts) - 1)) AS line_no, unnest(parts) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
  lines AS (SELECT doc_id, line_no, text, {CONFIDENCE_SQL} AS confidence, (8 * length(text))::DOUBLE AS x1, (20 * line_no)::DOUBLE AS y0, (20 * line_no + 16)::DOUBLE AS y1 FROM raw WHERE regexp_replace(text, '[\t\n\x0b\f\r ]+', '', 'g') <> '')"""
