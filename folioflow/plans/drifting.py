"""Report files whose fields drift: the list of changes and the unified tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.operators.drift import profiles, schema_changes, unified_names
from folioflow.plans.nested import parse_object
from folioflow.sources.tables import current_rows, table
from folioflow.storage import written

REPORTS = ("relation_metrics", "locked_test_ocr_metrics", "ocr_metrics")
#: Fields whose names below are data, not schema.
OPAQUE = ("per_class", "by_dataset")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All report files, once each; a stream is named with its kind of report."""
    one = lambda t: current_rows(table(spark, sf_dir, t), "report_id", ["stream_id", "payload", "recorded_at"]).select(
        F.concat_ws("|", F.lit(t), "stream_id").alias("stream"), "recorded_at", "report_id", "payload"
    )
    return reduce(DataFrame.unionByName, map(one, REPORTS))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = schema_changes(profiles(_files(spark, sf_dir), "stream", "recorded_at", "report_id", "payload", parse_object, OPAQUE))
    return found.withColumn("table_name", F.substring_index("stream", "|", 1))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("table_name", "report_id", "field_path", "change_kind").distinct()


def _flat(value: dict, path: str, out: dict) -> None:
    for n, v in value.items():
        at = f"{path}.{n}" if path else n
        if isinstance(v, dict) and n not in OPAQUE:
            _flat(v, at, out)
        elif v is not None:
            out[at] = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def flatten_payload(files: DataFrame) -> DataFrame:
    """(table_name, stream, recorded_at, report_id, path, value) of every non-null field."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = []
            for s, at, r, p in zip(*(b.column(i).to_pylist() for i in range(4))):
                out: dict = {}
                if (value := parse_object(p)) is not None:
                    _flat(value, "", out)
                rows.extend((s, at, r, k, v) for k, v in out.items())
            cols = list(zip(*rows)) or [[]] * 5
            types = [pa.string(), b.schema.field(1).type, pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["stream", "recorded_at", "report_id", "path", "value"])

    schema = files.select("stream", "recorded_at", "report_id").schema.add("path", "string").add("value", "string")
    return files.mapInArrow(run, schema).withColumn("table_name", F.substring_index("stream", "|", 1))


def p6_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per valid report; ``fields`` holds its values under unified names, as JSON text."""
    changes = written(_changes(spark, sf_dir), "changes")
    flat = written(flatten_payload(_files(spark, sf_dir)), "fields")
    key = F.concat_ws("|", "table_name", "path")
    paths = flat.groupBy(key.alias("path")).agg(F.count(F.lit(1)).alias("files"))
    pairs = changes.select("change_kind", "score", F.concat_ws("|", "table_name", "field_path").alias("field_path"), F.concat_ws("|", "table_name", "new_path").alias("new_path"))
    names = unified_names(pairs, paths).select(F.col("path").alias("_p"), F.substring_index("column", "|", -1).alias("column"))
    named = flat.join(names, key == F.col("_p")).groupBy("table_name", "report_id", "stream", "recorded_at", "column").agg(F.min_by("value", "path").alias("value"))
    entry = F.struct("column", "value")
    return named.groupBy("table_name", "report_id", F.substring_index("stream", "|", -1).alias("stream_id"), "recorded_at").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("fields"))


def _one(name: str) -> str:
    return f"SELECT '{name}' AS t, stream_id, recorded_at, report_id, payload FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY recorded_at DESC, ingested_at DESC) AS i FROM {name} WHERE report_id IS NOT NULL) WHERE i = 1 AND json_valid(payload)"


QUERIES = {"p6_found": p6_found, "p6_table": p6_table}
# the twin pairs fields that go and come one by one; with several below one parent the operator matches them
ORACLES = {
    "p6_found": f"""WITH RECURSIVE f AS ({' UNION ALL '.join(map(_one, REPORTS))}),
      g AS (SELECT t, stream_id, report_id, row_number() OVER (PARTITION BY t, stream_id ORDER BY recorded_at, report_id) AS n, CAST(payload AS JSON) AS j FROM f WHERE json_type(CAST(payload AS JSON)) = 'OBJECT'),
      p AS (SELECT t, stream_id, n, report_id, '' AS parent, e.key AS path, e.value AS v, e.key AS name FROM (SELECT *, unnest(map_entries(CAST(j AS MAP(VARCHAR, JSON)))) AS e FROM g)
        UNION ALL SELECT t, stream_id, n, report_id, path, path || '.' || e.key, e.value, e.key FROM (SELECT *, unnest(map_entries(CAST(v AS MAP(VARCHAR, JSON)))) AS e FROM p WHERE json_type(v) = 'OBJECT' AND name NOT IN ({', '.join(repr(x) for x in OPAQUE)}))),
      k AS (SELECT t, stream_id, n, report_id, parent, path, CASE WHEN v IS NULL OR json_type(v) = 'NULL' THEN NULL ELSE CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END END AS kind FROM p),
      e AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY t, stream_id, path ORDER BY n ROWS UNBOUNDED PRECEDING) AS eff FROM k),
      a AS (SELECT s.t, s.n, s.report_id, e.parent, e.path, e.eff FROM g s JOIN e ON e.t = s.t AND e.stream_id = s.stream_id AND e.n = s.n - 1), b AS (SELECT t, n, report_id, parent, path, eff FROM e WHERE n > 1),
      j AS (SELECT coalesce(a.t, b.t) AS t, coalesce(a.report_id, b.report_id) AS report_id, coalesce(a.parent, b.parent) AS parent, coalesce(a.path, b.path) AS path, a.path IS NOT NULL AS was, b.path IS NOT NULL AS stays, a.eff AS ea, b.eff AS eb
        FROM a FULL JOIN b ON a.t = b.t AND a.report_id = b.report_id AND a.path = b.path),
      ok AS (SELECT j.* FROM j LEFT JOIN j q ON q.t = j.t AND q.report_id = j.report_id AND q.path = j.parent WHERE j.parent = '' OR (q.was AND q.stays AND q.ea = 'object' AND q.eb = 'object')),
      c AS (SELECT *, count(*) FILTER (was AND NOT stays) OVER (PARTITION BY t, report_id, parent) AS goes, count(*) FILTER (stays AND NOT was) OVER (PARTITION BY t, report_id, parent) AS comes FROM ok)
      SELECT t AS table_name, report_id, path AS field_path, CASE WHEN was AND stays THEN 'type' WHEN was THEN CASE WHEN goes = 1 AND comes = 1 THEN 'renamed' ELSE 'removed' END ELSE 'added' END AS change_kind
      FROM c WHERE (was AND stays AND ea <> eb) OR (was AND NOT stays) OR (stays AND NOT was AND NOT (goes = 1 AND comes = 1))"""
}
