"""Queries over inventories and manifests: duplicates, pairing, samples, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.functions import sqlnames as S
from folioflow.functions.ids import file_id, hash_fraction, numbered_ids, stable_id
from folioflow.functions.names import numbered_name, plain_name, split_name
from folioflow.functions.text import human_bytes, truth
from folioflow.operators import audit as A, sampling
from folioflow.operators.components import connected_components
from folioflow.operators.skew import lookup_join
from folioflow.sources.tables import current_rows, table
from folioflow.storage import written


def _files(spark: SparkSession, d: str) -> DataFrame:
    """One row per recorded file path of raw_baseline: the latest record."""
    raw = table(spark, d, "raw_baseline").withColumn("ingested_at", F.col("recorded_at"))
    return current_rows(raw.select("file_id", plain_name(F.col("dataset")).alias("dataset"), F.lower("sha256").alias("digest"), "safe_path", "private", "size_bytes", "recorded_at", "ingested_at"), "file_id", ["dataset", "digest", "safe_path", "private", "size_bytes"])


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(
        table(spark, d, "validation").select(
            "page_id", "recorded_at", "ingested_at", plain_name(F.col("dataset")).alias("dataset"), split_name(F.col("project_split")).alias("split"), plain_name(F.col("document_id")).alias("document"),
            numbered_name(F.col("template_family")).alias("family"), numbered_name(F.col("exact_duplicate_group")).alias("exact"), "document_type", "private_status", "selection_status", F.lower(F.trim("exclusion_reason")).alias("reason"),
        ),
        "page_id", ["dataset", "split", "document", "family", "exact", "document_type", "private_status", "selection_status", "reason"],
    )


def exact_duplicates(spark, d):
    return A.exact_duplicates(_files(spark, d), "digest")


def duplicate_report(spark, d):
    return A.duplicate_report(_files(spark, d), "digest", "dataset", "file_id")


def text_duplicates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return A.duplicate_report(docs, "digest", "source", "doc_id")


def unpaired_files(spark, d):
    """Files without a current page and pages' files that aren't in the inventory."""
    pages = table(spark, d, "validation").select(F.col("source_file_id").alias("file_id")).where("file_id IS NOT NULL")
    return A.unpaired(_files(spark, d), pages, ["file_id"], ("inventory", "page"))


def unpaired_orders(spark, d):
    return A.unpaired(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"], ("order", "item"))


def prefix_match(spark, d):
    """Paths matched to the longest prefix that is a component of the manifest."""
    keys = table(spark, d, "raw_baseline").select(F.replace(F.substring_index("safe_path", "/", 3), F.lit("/"), F.lit("_")).alias("stem")).distinct()
    stems = table(spark, d, "validation").select(F.concat_ws("_", plain_name(F.col("dataset")), "dataset_component").alias("prefix"))
    return A.longest_prefix(keys, "stem", stems, "prefix")


def near_duplicates(spark, d):
    return A.near_text_groups(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("group").alias("class_id"))


def duplicate_components(spark, d):
    """Documents linked by equal text or equal text of their first line, per component."""
    docs = written(table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc"), F.sha2("text", 256).alias("t"), F.sha2(F.substring_index("text", "\n", 1), 256).alias("f")), "docs")
    edges = docs.select(F.concat(F.lit("d"), "doc").alias("a"), F.concat(F.lit("t"), "t").alias("b")).unionByName(docs.select(F.concat(F.lit("d"), "doc").alias("a"), F.concat(F.lit("f"), "f").alias("b")))
    roots = connected_components(edges, "a", "b")
    return docs.select("doc", F.concat(F.lit("d"), "doc").alias("n")).join(roots, F.col("n") == F.col("node"), "left").select(F.col("doc").cast("bigint").alias("doc_id"), F.substring(F.coalesce("root", "n"), 2, 99).cast("bigint").alias("component"))


def split_leakage(spark, d):
    return A.leakage(_pages(spark, d), "split", {"document": F.when(F.col("document").isNotNull(), F.concat_ws("|", "dataset", "document")), "family": F.when(F.col("family").isNotNull(), F.concat_ws("|", "dataset", "family")), "exact": F.when(F.col("exact").isNotNull(), F.concat_ws("|", "dataset", "exact"))})


def leakage_safe_split(spark, d):
    """Files of one digest stay together; components are dealt out 70/10/5/15."""
    files = written(_files(spark, d).select("file_id", F.coalesce("digest", "file_id").alias("component")), "files")
    sizes = written(files.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
    dealt = A.deal_components(sizes, "component", "n", {"train": 0.70, "dev_select": 0.10, "dev_calibration": 0.05, "test_in_domain": 0.15}).select(F.col("component").alias("_c"), "split")
    return lookup_join(files, "component", dealt, "_c", "inner").select("file_id", "component", "split")


def hash_split(spark, d):
    f = hash_fraction(F.col("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", f.alias("fraction"), F.when(f < 0.15, "validation").otherwise("train").alias("split"))


def quota_apportionment(spark, d):
    sizes = table(spark, d, "documents").groupBy(F.coalesce("document_type", F.lit("none")).alias("document_type")).agg(F.count(F.lit(1)).alias("size"))
    return sampling.apportion(sizes, "document_type", "size", 97)


def round_robin_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.coalesce("document_type", F.lit("none")).alias("document_type"))
    return sampling.round_robin(docs, ["document_type", "source"], "doc_id", 120)


def proportional_sample(spark, d):
    return sampling.proportional(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 60).select("c_custkey", "c_mktsegment", "rank_in_stratum")


def smoke_topk(spark, d):
    return sampling.smoke(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], "o_orderkey", 5)


def weighted_sample(spark, d):
    return sampling.weighted(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 50, {"Brand#11": 0.2, "Brand#22": 0.3, "Brand#33": 0.5}).select("p_partkey", "p_brand")


def unique_hashes(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"))
    return sampling.unique_first(docs, "digest", "doc_id").select("doc_id", "is_unique")


def document_ids(spark, d):
    return numbered_ids(_pages(spark, d), "dataset", "document")


def file_ids(spark, d):
    raw = table(spark, d, "raw_baseline").select("safe_path", plain_name(F.col("dataset")).alias("dataset")).distinct()
    return raw.select("dataset", "safe_path", file_id(F.col("dataset"), F.col("safe_path")).alias("made_id"), stable_id("page", F.col("dataset"), F.col("safe_path"), length=14).alias("stable_id"))


def id_collisions(spark, d):
    return table(spark, d, "raw_baseline").groupBy("file_id").agg(F.count_distinct("safe_path").alias("paths")).where("paths > 1")


def inventory_summary(spark, d):
    f = _files(spark, d)
    ext = F.lower(F.substring_index("safe_path", ".", -1))
    return f.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("private")).alias("private_files"), F.sum("size_bytes").alias("bytes"), F.count_if(F.col("digest").isNull()).alias("no_digest"),
        F.count_distinct("digest").alias("digests"), F.count_if(F.col("size_bytes") == 0).alias("empty_files"), F.count_if(ext == "jpg").alias("jpg_files"), F.max("size_bytes").alias("largest"),
    )


def extension_histogram(spark, d):
    f = _files(spark, d).select("dataset", F.lower(F.substring_index("safe_path", ".", -1)).alias("ext"), F.try_element_at(F.split("safe_path", "/"), F.lit(2)).alias("component"))
    return f.groupBy("dataset", "component", "ext").agg(F.count(F.lit(1)).alias("n"))


def slice_rollup(spark, d):
    """Counts by grouping sets: everything, per dataset, per split, per dataset and split."""
    p = _pages(spark, d).select("dataset", F.coalesce("split", F.lit("none")).alias("split"), "document")
    p.createOrReplaceTempView("folioflow_pages")
    return spark.sql("SELECT dataset, split, count(*) AS pages, count(DISTINCT document) AS documents FROM folioflow_pages GROUP BY GROUPING SETS ((), (dataset), (split), (dataset, split))")


def sales_rollup(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"])
    return j.rollup("o_orderstatus", "l_returnflag").agg(F.count(F.lit(1)).alias("items"), F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double").alias("quantity"), F.grouping_id().alias("level"))


def excluded_pages(spark, d):
    """First reason that applies to a page, in a fixed order."""
    reason = F.coalesce(F.when(F.col("private_status") == "private", "private"), F.when(F.col("reason") != "", F.col("reason")), F.when(F.col("selection_status") != "selected", "not_selected"), F.when(F.col("split").isNull(), "no_split"))
    return _pages(spark, d).select("page_id", reason.alias("why")).where("why IS NOT NULL")


def size_labels(spark, d):
    return _files(spark, d).select("file_id", human_bytes(F.col("size_bytes").cast("double")).alias("label"), truth(F.col("private").cast("string")).alias("is_private"))


def baseline_changes(spark, d):
    """What each run's record of a file differs in from the run before."""
    raw = table(spark, d, "raw_baseline").groupBy("file_id", "baseline_run").agg(F.max(F.struct("recorded_at", F.lower("sha256").alias("digest"), "size_bytes")).alias("r"))
    a, b = raw.alias("a"), raw.alias("b")
    j = a.join(b, (F.col("a.file_id") == F.col("b.file_id")) & (F.col("a.baseline_run") + 1 == F.col("b.baseline_run")), "full")
    status = F.when(F.col("a.r").isNull(), "added").when(F.col("b.r").isNull(), "missing").when(F.col("a.r.digest").eqNullSafe(F.col("b.r.digest")) & F.col("a.r.size_bytes").eqNullSafe(F.col("b.r.size_bytes")), "same").otherwise("changed")
    return j.groupBy(F.coalesce("b.baseline_run", F.col("a.baseline_run") + 1).alias("run"), status.alias("status")).agg(F.count(F.lit(1)).alias("files"))


_FILES = f"""files AS (SELECT file_id, {S.plain('dataset')} AS dataset, lower(sha256) AS digest, safe_path, private, size_bytes FROM (
    SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY recorded_at DESC, {S.plain('dataset')} DESC, lower(sha256) DESC NULLS LAST, safe_path DESC, private DESC, size_bytes DESC) AS r FROM raw_baseline) WHERE r = 1)"""
_PAGES = f"""pages AS (SELECT page_id, {S.plain('dataset')} AS dataset, {S.split('project_split')} AS split, {S.plain('document_id')} AS document, {S.numbered('template_family')} AS family, {S.numbered('exact_duplicate_group')} AS exact,
    document_type, private_status, selection_status, lower(trim(exclusion_reason)) AS reason FROM {S.current('validation', 'page_id')})"""
_RANK = "sha256('42|' || {})"
QUERIES = {f.__name__: f for f in (
    exact_duplicates, duplicate_report, text_duplicates, unpaired_files, unpaired_orders, prefix_match, near_duplicates, duplicate_components, split_leakage, leakage_safe_split, hash_split,
    quota_apportionment, round_robin_sample, proportional_sample, smoke_topk, weighted_sample, unique_hashes, document_ids, file_ids, id_collisions, inventory_summary, extension_histogram,
    slice_rollup, sales_rollup, excluded_pages, size_labels, baseline_changes,
)}
_REPORT = """g AS (SELECT digest, count(*) AS n, arg_min(k, (s, k)) AS canonical, arg_min(s, (s, k)) AS cs, min(s) <> max(s) AS crosses FROM m WHERE digest <> '' GROUP BY 1 HAVING count(*) > 1)"""
ORACLES = {
    "exact_duplicates": f"WITH {_FILES} SELECT digest, count(*) AS n FROM files WHERE digest <> '' GROUP BY 1 HAVING count(*) > 1",
    "duplicate_report": f"WITH {_FILES}, m AS (SELECT digest, dataset AS s, file_id AS k FROM files), {_REPORT} SELECT digest, s AS dataset, k AS file_id, n, canonical, crosses, s = cs AND k = canonical AS is_canonical FROM m JOIN g USING (digest)",
    "text_duplicates": f"WITH m AS (SELECT sha256(text) AS digest, source AS s, doc_id AS k FROM documents), {_REPORT} SELECT digest, s AS source, k AS doc_id, n, canonical, crosses, s = cs AND k = canonical AS is_canonical FROM m JOIN g USING (digest)",
    "unpaired_files": """WITH a AS (SELECT DISTINCT file_id FROM raw_baseline), b AS (SELECT DISTINCT source_file_id AS file_id FROM validation WHERE source_file_id IS NOT NULL)
        SELECT file_id, 'page' AS missing FROM a WHERE file_id NOT IN (SELECT file_id FROM b) UNION ALL SELECT file_id, 'inventory' FROM b WHERE file_id NOT IN (SELECT file_id FROM a)""",
    "unpaired_orders": """SELECT o_orderkey AS k, 'item' AS missing FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
        UNION ALL SELECT DISTINCT l_orderkey, 'order' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
    "prefix_match": f"""WITH k AS (SELECT DISTINCT array_to_string(string_split(safe_path, '/')[1:3], '_') AS stem FROM raw_baseline), s AS (SELECT DISTINCT {S.plain('dataset')} || '_' || dataset_component AS p FROM validation)
        SELECT stem, arg_max(p, length(p)) AS matched FROM k LEFT JOIN s ON stem = p OR starts_with(stem, p || '_') GROUP BY 1""",
    "duplicate_components": """WITH RECURSIVE d AS (SELECT doc_id, sha256(text) AS t, sha256(string_split(text, chr(10))[1]) AS f FROM documents WHERE text IS NOT NULL),
        e AS (SELECT doc_id AS n, 't' || t AS h FROM d UNION ALL SELECT doc_id, 'f' || f FROM d), p AS (SELECT DISTINCT a.n AS a, b.n AS b FROM e a JOIN e b USING (h)),
        r AS (SELECT a AS n, a AS m FROM p UNION SELECT p.b, r.m FROM r JOIN p ON p.a = r.n)
        SELECT n AS doc_id, min(m::VARCHAR)::BIGINT AS component FROM r GROUP BY 1""",
    "split_leakage": f"""WITH {_PAGES}, i AS (SELECT split, 'document' AS kind, dataset || '|' || document AS identity FROM pages WHERE document IS NOT NULL UNION ALL SELECT split, 'family', dataset || '|' || family FROM pages WHERE family IS NOT NULL
        UNION ALL SELECT split, 'exact', dataset || '|' || exact FROM pages WHERE exact IS NOT NULL) SELECT kind, identity, count(DISTINCT split) AS splits FROM i WHERE split IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""",
    "hash_split": f"""WITH f AS (SELECT o_orderkey, ('0x' || substr({_RANK.format('o_custkey')}, 1, 8))::UBIGINT::DOUBLE / 4294967295.0 AS fraction FROM orders) SELECT *, CASE WHEN fraction < 0.15 THEN 'validation' ELSE 'train' END AS split FROM f""",
    "quota_apportionment": """WITH s AS (SELECT coalesce(document_type, 'none') AS document_type, count(*) AS size FROM documents GROUP BY 1), e AS (SELECT *, size * 97.0::DOUBLE / sum(size) OVER () AS x FROM s),
        q AS (SELECT *, floor(x) AS f, row_number() OVER (ORDER BY round(x - floor(x), 12) DESC, size DESC, document_type) AS p, 97 - sum(floor(x)) OVER () AS l FROM e) SELECT document_type, size, (f + CASE WHEN p <= l THEN 1 ELSE 0 END)::BIGINT AS quota FROM q""",
    "round_robin_sample": f"""WITH r AS (SELECT doc_id, source, coalesce(document_type, 'none') AS document_type, row_number() OVER (PARTITION BY coalesce(document_type, 'none'), source ORDER BY {_RANK.format('doc_id')}, doc_id) AS rank_in_stratum FROM documents)
        SELECT * FROM r ORDER BY rank_in_stratum, document_type, source LIMIT 120""",
    "proportional_sample": f"""WITH s AS (SELECT c_mktsegment, count(*) AS size FROM customer GROUP BY 1), e AS (SELECT *, size * 60.0::DOUBLE / sum(size) OVER () AS x FROM s),
        q AS (SELECT c_mktsegment, floor(x) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x), 12) DESC, size DESC, c_mktsegment) <= 60 - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS quota FROM e),
        r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_RANK.format('c_custkey')}, c_custkey) AS rank_in_stratum FROM customer) SELECT c_custkey, c_mktsegment, rank_in_stratum FROM r JOIN q USING (c_mktsegment) WHERE rank_in_stratum <= quota""",
    "smoke_topk": f"SELECT * FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_RANK.format('o_orderkey')}, o_orderkey) AS rank_in_stratum FROM orders) WHERE rank_in_stratum <= 5",
    "weighted_sample": f"""WITH r AS (SELECT p_partkey, p_brand, {_RANK.format('p_partkey')} AS h, row_number() OVER (PARTITION BY p_brand ORDER BY {_RANK.format('p_partkey')}, p_partkey) AS i FROM part)
        SELECT p_partkey, p_brand FROM r ORDER BY CASE WHEN i <= CASE p_brand WHEN 'Brand#11' THEN 10 WHEN 'Brand#22' THEN 15 WHEN 'Brand#33' THEN 25 END THEN 0 ELSE 1 END, h, p_partkey LIMIT 50""",
    "unique_hashes": f"SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY {_RANK.format('doc_id')}, doc_id) = 1 AS is_unique FROM documents WHERE text IS NOT NULL",
    "document_ids": f"WITH {_PAGES}, k AS (SELECT DISTINCT dataset, document FROM pages WHERE document IS NOT NULL) SELECT dataset, document, dataset || '_' || lpad((row_number() OVER (PARTITION BY dataset ORDER BY document) - 1)::VARCHAR, 6, '0') AS document_id FROM k",
    "file_ids": f"""WITH k AS (SELECT DISTINCT {S.plain('dataset')} AS dataset, safe_path FROM raw_baseline) SELECT dataset, safe_path, dataset || '_' || substr(sha256(dataset || '|' || regexp_replace(replace(safe_path, chr(92), '/'), '^[./]+', '')), 1, 12) AS made_id,
        'page_' || substr(sha256(dataset || '|' || replace(safe_path, chr(92), '/')), 1, 14) AS stable_id FROM k""",
    "id_collisions": "SELECT file_id, count(DISTINCT safe_path) AS paths FROM raw_baseline GROUP BY 1 HAVING count(DISTINCT safe_path) > 1",
    "inventory_summary": f"""WITH {_FILES} SELECT dataset, count(*) AS files, count(*) FILTER (private) AS private_files, sum(size_bytes)::BIGINT AS bytes, count(*) FILTER (digest IS NULL) AS no_digest, count(DISTINCT digest) AS digests,
        count(*) FILTER (size_bytes = 0) AS empty_files, count(*) FILTER (safe_path ILIKE '%.jpg') AS jpg_files, max(size_bytes) AS largest FROM files GROUP BY 1""",
    "extension_histogram": f"WITH {_FILES} SELECT dataset, string_split(safe_path, '/')[2] AS component, lower(string_split(safe_path, '.')[-1]) AS ext, count(*) AS n FROM files GROUP BY 1, 2, 3",
    "slice_rollup": f"WITH {_PAGES}, p AS (SELECT dataset, coalesce(split, 'none') AS split, document FROM pages) SELECT dataset, split, count(*) AS pages, count(DISTINCT document) AS documents FROM p GROUP BY GROUPING SETS ((), (dataset), (split), (dataset, split))",
    "sales_rollup": "SELECT o_orderstatus, l_returnflag, count(*) AS items, sum(l_quantity::DECIMAL(12,2))::DOUBLE AS quantity, grouping(o_orderstatus, l_returnflag) AS level FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ROLLUP (o_orderstatus, l_returnflag)",
    "size_labels": f"""WITH {_FILES} SELECT file_id, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN printf('%.2f KB', size_bytes / 1024.0::DOUBLE) WHEN size_bytes < 1073741824 THEN printf('%.2f MB', size_bytes / 1048576.0::DOUBLE)
        WHEN size_bytes < 1099511627776 THEN printf('%.2f GB', size_bytes / 1073741824.0::DOUBLE) ELSE printf('%.2f TB', size_bytes / 1099511627776.0::DOUBLE) END AS label, coalesce(private, false) AS is_private FROM files WHERE size_bytes IS NOT NULL UNION ALL SELECT file_id, NULL, coalesce(private, false) FROM files WHERE size_bytes IS NULL""",
    "excluded_pages": f"WITH {_PAGES}, w AS (SELECT page_id, CASE WHEN private_status = 'private' THEN 'private' WHEN reason <> '' THEN reason WHEN selection_status <> 'selected' THEN 'not_selected' WHEN split IS NULL THEN 'no_split' END AS why FROM pages) SELECT * FROM w WHERE why IS NOT NULL",
    "baseline_changes": """WITH r AS (SELECT file_id, baseline_run, lower(sha256) AS digest, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY file_id, baseline_run ORDER BY recorded_at DESC, lower(sha256) DESC NULLS LAST, size_bytes DESC) AS i FROM raw_baseline) WHERE i = 1)
        SELECT coalesce(b.baseline_run, a.baseline_run + 1) AS run, CASE WHEN a.file_id IS NULL THEN 'added' WHEN b.file_id IS NULL THEN 'missing' WHEN a.digest IS NOT DISTINCT FROM b.digest AND a.size_bytes IS NOT DISTINCT FROM b.size_bytes THEN 'same' ELSE 'changed' END AS status,
        count(*) AS files FROM r a FULL JOIN r b ON a.file_id = b.file_id AND a.baseline_run + 1 = b.baseline_run GROUP BY 1, 2""",
}
