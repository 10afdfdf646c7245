"""Queries through files: what is written to the shared folder and read back, listed and compared.

Each query writes its small files below a folder of its own in the shared
folder, which is deleted when the driver ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.functions import text as X
from folioflow.operators import extract as E, recognition as R, validation as V
from folioflow.sources import adapters as A, discovery as D, inventory as I, sinks as S
from folioflow.sources.tables import table
from folioflow.storage import _filesystem, path_for


def _folder(spark: SparkSession, label: str) -> str:
    path = path_for(spark, label)
    p, fs = _filesystem(spark, path)
    fs.deleteOnExit(p)
    return path


def _files(spark: SparkSession, d: str, label: str, ending: str = "") -> str:
    """One text file per nation, in a folder per region."""
    root = _folder(spark, label)
    rows = table(spark, d, "nation").select(F.concat(F.lit('{"nation":"'), "n_name", F.lit('"}'), F.lit(ending)).alias("value"), F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"))
    rows.coalesce(1).write.partitionBy("region", "nation").text(root)
    return root


def csv_round_trip(spark, d):
    """Customers through a CSV file: all columns come back as text, numbers and nested values too."""
    path = _folder(spark, "csv") + "/customers"
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.struct("c_nationkey").alias("nested"), F.when(F.col("c_custkey") % 7 == 0, float("nan")).otherwise(F.col("c_custkey") / 2).alias("number"), F.concat(F.lit('say "'), "c_name", F.lit('", twice')).alias("quoted"))
    S.write_csv(c, path, ["c_custkey", "c_name", "nested", "number", "quoted"])
    return S.read_csv(spark, path)


def json_round_trip(spark, d):
    path = _folder(spark, "json") + "/customers"
    S.write_json(table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 7 == 0, float("nan")).otherwise(F.col("c_custkey") / 2).alias("number")), path)
    return spark.read.schema("c_custkey bigint, c_name string, number double").json(path)


def parts_round_trip(spark, d):
    """Orders in a folder per status; only one folder is read."""
    path = _folder(spark, "parts") + "/orders"
    S.write_parts(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path, ["o_orderstatus"])
    return spark.read.parquet(path).where("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_custkey").alias("customers"))


def cache_round_trip(spark, d):
    """Orders as cached results: put twice and once more with later ones, private ones never; what comes back for all keys."""
    path = _folder(spark, "cache") + "/c"
    o = table(spark, d, "orders").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("key"), "o_orderkey", (F.col("o_orderkey") % 5 == 0).alias("private"))
    old = o.where("o_orderkey % 2 = 0")
    first, again, rest = S.cache_put(old, path, "key", "private"), S.cache_put(old, path, "key", "private"), S.cache_put(o, path, "key", "private")
    return S.cache_get(spark, path, o, "key").agg(F.count(F.lit(1)).alias("kept"), F.sum("o_orderkey").alias("total")).withColumns({"first": F.lit(first), "again": F.lit(again), "rest": F.lit(rest)})


def file_inventory(spark, d):
    """The inventory of a folder of files that the query has written."""
    inv = I.inventory(spark, _files(spark, d, "files", "\n"), "nations")
    inv = inv.where(~F.contains("original_filename", F.lit("_SUCCESS")) & ~F.startswith("original_filename", F.lit(".")))
    return inv.select(F.regexp_replace("original_relative_path", "/[^/]*$", "").alias("folder"), "dataset", "document_category", "extension", "mime_type", "size_bytes", "sha256", "is_private", "is_annotation", "is_image", "is_pdf", "is_readable", "is_empty", "notes")


def tree_changes(spark, d):
    """Two trees of the same files, a region's in the second changed, another's gone."""
    one = I.inventory(spark, _files(spark, d, "before"), "n").withColumn("original_relative_path", F.regexp_replace("original_relative_path", "/[^/]*$", "")).where("original_relative_path LIKE 'region=%'")
    two = one.where("original_relative_path NOT LIKE 'region=2/%'").withColumn("sha256", F.when(F.col("original_relative_path").like("region=1/%"), F.lit("other")).otherwise(F.col("sha256")))
    return I.compare_trees(one, two).groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def native_splits(spark, d):
    """Part names listed for train, validation and test; a later list wins."""
    p = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("stem"), "p_partkey")
    return D.native_splits({"train": p, "validation": p.where("p_partkey % 3 = 0"), "test": p.where("p_partkey % 5 = 0")}, "stem")


def dataset_signatures(spark, d):
    """Which dataset each folder of the recorded files looks like."""
    p = F.replace(F.col("safe_path"), F.lit("\\"), F.lit("/"))
    rows = table(spark, d, "raw_baseline").where("safe_path IS NOT NULL").select(p.alias("p"), F.lower(F.element_at(F.split(p, "/"), 1)).alias("root"))
    return D.discover(rows, "p", F.col("root"), {"forms": {"markers": ["form_pages"], "names": ["funsd"], "suffixes": [".json"]}, "slips": {"markers": [], "names": ["coru", "sroie"], "suffixes": [".csv", ".jpg"]}})


def manifest_drift(spark, d):
    """Orders as a manifest, a part of them as examples with other customers: what differs or is missing."""
    m = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    e = m.where("o_orderkey % 4 <> 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return D.drifted(m, e, "o_orderkey", ["o_custkey", "o_orderstatus"]).groupBy("column").agg(F.count(F.lit(1)).alias("n"))


def file_names(spark, d):
    """Parts' names as file names: their group, their slug and what is left without a lone quote."""
    name = F.concat_ws(" ", "p_name", F.lit("(final)"), F.when(F.col("p_partkey") % 3 == 0, F.lit('"')))
    groups = [("metal", ("tin", "nickel", "brass", "steel", "copper")), ("even", ("2", "4"))]
    return table(spark, d, "part").select("p_partkey", I.filename_category(name, groups).alias("category"), X.slug(name).alias("slug"), X.drop_lone_quote(name).alias("plain"))


def source_texts(spark, d):
    """Names as bytes in two encodings, with and without a mark: the same text comes back."""
    utf8 = F.encode("n_name", "UTF-8")
    as_bytes = F.when(F.col("n_nationkey") % 3 == 0, F.encode(F.concat("n_name", F.lit("é")), "ISO-8859-1")).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit(bytes([0xEF, 0xBB, 0xBF])), utf8)).otherwise(utf8)
    return table(spark, d, "nation").select("n_nationkey", D.decode_source(as_bytes).alias("text"))


def routes(spark, d):
    """Which recogniser a text's mode names, and why the Thai one should be tried, too."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    why = R.route_reasons((F.col("doc_id") % 10) / F.lit(10.0), F.size(F.split("text", " ")), F.lit(1.0), F.col("text"), F.col("lang"))
    return t.groupBy(F.coalesce(R.route_for_mode(F.col("lang")), F.lit("none")).alias("route"), F.array_join(why, ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


def selected_routes(spark, d):
    """Per user the event of best value as the chosen candidate, of equals the one named view."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.floor("value")).alias("v"))
    return R.best_candidate(e, ["user_id"], F.col("v"), "event_type", "view").select("user_id", "selected", F.col("score").cast("bigint").alias("score"), R.second_pass(F.lit(300), F.col("score")).alias("replaced"))


def review_rows(spark, d):
    """Customers' values as fields for review: those that aren't null, by name."""
    field = lambda v: F.struct(v.cast("string").alias("value"), (F.col("c_custkey") % 7 / F.lit(7.0)).alias("confidence"))
    c = table(spark, d, "customer").select("c_custkey", F.create_map(F.lit("name"), field(F.col("c_name")), F.lit("nation"), field(F.when(F.col("c_nationkey") > 5, F.col("c_nationkey"))), F.lit("never"), field(F.lit(None))).alias("fields"), F.repeat("c_name", 400).alias("t"))
    rows = V.review_rows(c, "c_custkey", "fields")
    sent = V.review_payload(c, "c_custkey", "fields", "t", ["name"], True).select("c_custkey", F.length("text").alias("sent"), F.size("fields").alias("selected"))
    return rows.join(sent, "c_custkey")


def lineage_steps(spark, d):
    """Orders as samples that a step is derived from."""
    o = table(spark, d, "orders").select(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("sample_id"), F.array(F.lit("read")).alias("transformations"))
    n = V.derive(o, F.concat("sample_id", F.lit("-r")), "rotate")
    return n.select("sample_id", "parent_sample_id", F.array_join("transformations", ">").alias("steps"))


def secret_texts(spark, d):
    """Parts' comments as lines of code, some of which hold a key."""
    line = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("api_key = '"), F.sha2(F.col("p_partkey").cast("string"), 256), F.lit("'"))).otherwise(F.concat(F.lit("name = '"), "p_name", F.lit("'")))
    return V.secret_lines(table(spark, d, "part").select("p_partkey", line.alias("line")), "line").select("p_partkey")


def unfit_roles(spark, d):
    return V.allowed_roles(table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("role")), "role", ["F"]).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def merged_entities(spark, d):
    """Orders of the first half with those of all others that they haven't."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return E.merge_missing(o.where("o_orderkey % 3 = 0").withColumn("o_custkey", F.lit(0).cast("bigint")), o, ["o_orderkey"])


QUERIES = {f.__name__: f for f in (
    csv_round_trip, json_round_trip, parts_round_trip, cache_round_trip, file_inventory, tree_changes, native_splits, dataset_signatures, manifest_drift, file_names, source_texts, routes, selected_routes, review_rows, lineage_steps, secret_texts,
    unfit_roles, merged_entities,
)}
_BODY = "'{\"nation\":\"' || n_name || '\"}' || chr(10) || chr(10)"
ORACLES = {
    "csv_round_trip": """SELECT c_custkey::VARCHAR AS c_custkey, c_name, '{"c_nationkey":' || c_nationkey || '}' AS nested, CASE WHEN c_custkey % 7 > 0 THEN (c_custkey / 2.0::DOUBLE)::VARCHAR END AS number, 'say "' || c_name || '", twice' AS quoted FROM customer""",
    "json_round_trip": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 > 0 THEN c_custkey / 2.0::DOUBLE END AS number FROM customer",
    "parts_round_trip": "SELECT o_orderstatus, count(*) AS orders, sum(o_custkey)::BIGINT AS customers FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    "cache_round_trip": "SELECT count(*) AS kept, sum(o_orderkey)::BIGINT AS total, count(*) FILTER (o_orderkey % 2 = 0) AS first, 0 AS again, count(*) FILTER (o_orderkey % 2 = 1) AS rest FROM orders WHERE o_orderkey % 5 > 0",
    "file_inventory": f"""SELECT 'region=' || n_regionkey || '/nation=' || n_nationkey AS folder, 'nations' AS dataset, 'unknown' AS document_category, '.txt' AS extension, 'text/plain' AS mime_type, strlen({_BODY})::BIGINT AS size_bytes, sha256({_BODY}) AS sha256,
        false AS is_private, false AS is_annotation, false AS is_image, false AS is_pdf, true AS is_readable, false AS is_empty, '' AS notes FROM nation""",
    "tree_changes": "SELECT CASE n_regionkey WHEN 1 THEN 'changed' ELSE 'missing' END AS status, count(*) AS files FROM nation WHERE n_regionkey IN (1, 2) GROUP BY 1",
    "native_splits": "SELECT 'p' || p_partkey AS stem, CASE WHEN p_partkey % 5 = 0 THEN 'test' WHEN p_partkey % 3 = 0 THEN 'validation' ELSE 'train' END AS split FROM part",
    "dataset_signatures": r"""WITH p AS (SELECT lower(replace(safe_path, chr(92), '/')) AS p FROM raw_baseline WHERE safe_path IS NOT NULL), r AS (SELECT string_split(p, '/')[1] AS root, p FROM p),
        g AS (SELECT root, bool_or(contains(p, 'form_pages')) AS m, contains(root, 'funsd') AS fn, least(50, count(*) FILTER (p LIKE '%.json')) AS fj, contains(root, 'coru') OR contains(root, 'sroie') AS sn, least(50, count(*) FILTER (p LIKE '%.csv' OR p LIKE '%.jpg')) AS sf FROM r GROUP BY root)
        SELECT root, 'forms' AS dataset, CASE WHEN m THEN 'high' WHEN fn AND fj > 0 THEN 'medium' ELSE 'low' END AS confidence, fj AS files FROM g UNION ALL SELECT root, 'slips', CASE WHEN sn AND sf > 0 THEN 'medium' ELSE 'low' END, sf FROM g""",
    "manifest_drift": "SELECT CASE WHEN o_orderkey % 4 = 0 THEN '(missing)' ELSE 'o_custkey' END AS column, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 GROUP BY 1",
    "file_names": r"""WITH n AS (SELECT p_partkey, concat_ws(' ', p_name, '(final)', CASE WHEN p_partkey % 3 = 0 THEN '"' END) AS n FROM part)
        SELECT p_partkey, CASE WHEN regexp_matches(lower(n), 'tin|nickel|brass|steel|copper') THEN 'metal' WHEN regexp_matches(n, '2|4') THEN 'even' ELSE 'unclassified' END AS category, substr(regexp_replace(regexp_replace(n, '[^A-Za-z0-9._-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), 1, 60) AS slug, replace(n, '"', '') AS plain FROM n""",
    "source_texts": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name || 'é' ELSE n_name END AS text FROM nation",
    "routes": """WITH r AS (SELECT CASE WHEN lower(trim(coalesce(lang, 'auto'))) IN ('general', 'en', 'tr') THEN 'general' WHEN lower(trim(coalesce(lang, 'auto'))) IN ('thai', 'th') THEN 'thai' ELSE 'none' END AS route,
        concat_ws(',', CASE WHEN lower(lang) IN ('th', 'thai', 'th-th') THEN 'metadata_or_user_hint_is_thai' END, CASE WHEN regexp_matches(text, '[\\x{0E00}-\\x{0E7F}]') THEN 'general_output_contains_thai_script' END, CASE WHEN (doc_id % 10) / 10.0 < 0.55 THEN 'general_confidence_is_low' END,
        CASE WHEN len(string_split(text, ' ')) < 2 THEN 'general_output_is_empty_or_weak' END) AS reasons FROM documents WHERE text IS NOT NULL) SELECT route, reasons, count(*) AS n FROM r GROUP BY 1, 2""".replace("\\\\", "\\"),
    "selected_routes": """WITH e AS (SELECT user_id, event_type, max(floor(value))::BIGINT AS v FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, (event_type = 'view') DESC, event_type DESC) AS i FROM e) SELECT user_id, event_type AS selected, v AS score, v > 300 AS replaced FROM r WHERE i = 1""",
    "review_rows": """WITH c AS (SELECT c_custkey, c_name, c_nationkey, round((c_custkey % 7) / 7.0::DOUBLE, 4) AS k, least(4000, 400 * length(c_name)) AS sent FROM customer)
        SELECT c_custkey, 'name' AS field, c_name AS value, k AS confidence, '' AS correct_value, '' AS note, sent, 1 AS selected FROM c UNION ALL SELECT c_custkey, 'nation', c_nationkey::VARCHAR, k, '', '', sent, 1 FROM c WHERE c_nationkey > 5""",
    "lineage_steps": "SELECT 's' || o_orderkey || '-r' AS sample_id, 's' || o_orderkey AS parent_sample_id, 'read>rotate' AS steps FROM orders",
    "secret_texts": "SELECT p_partkey FROM part WHERE p_partkey % 4 = 0",
    "unfit_roles": "SELECT nullif(o_orderstatus, 'P') AS role, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1",
    "merged_entities": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS o_custkey FROM orders",
}
