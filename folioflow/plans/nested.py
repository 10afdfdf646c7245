"""Reports and registries as flat tables of classes, datasets, errors, models and files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.operators.shredding import Group, infer, schema_of, shred
from folioflow.sources.tables import current_rows, table

CLASSES = ("class", "name", "label")
DATASETS = ("dataset", "name")
#: The collections of a relation report; everything else follows from the data.
RELATION_CHILDREN = {"per_class": ("class", CLASSES), "by_dataset": ("dataset", DATASETS), "by_dataset[].metrics.relation_per_class": ("dataset_class", CLASSES)}


def relation_schema(values: list) -> Group:
    node = infer(values, RELATION_CHILDREN)
    return node if isinstance(node, Group) else Group({})


def parse_object(text: str | None) -> dict | None:
    """The object of a JSON text; None for null, invalid or other JSON."""

    def refuse(name: str):
        raise ValueError(name)

    try:
        value = json.loads(text, parse_constant=refuse) if text is not None else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _tables(df: DataFrame, name: str, children: DataFrame) -> DataFrame:
    return children.select(
        F.lit(name).alias("table_name"), "record_id", "child", "entry", "parent_entry", F.coalesce("parent_key", F.lit("")).alias("parent_key"), F.coalesce("child_key", F.lit("")).alias("child_key"), "fields"
    )


def _nested(spark: SparkSession, sf_dir: str, name: str, key: str, columns: list[str], children: dict) -> DataFrame:
    raw = table(spark, sf_dir, name)
    # maps can't be compared, so of deliveries of one time the one whose JSON text is last is picked
    picked = raw.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("recorded_at", "ingested_at", F.to_json(F.struct(*columns)))).alias("row"))
    return _tables(picked, name, shred(picked, key, "row", schema_of(picked.schema["row"].dataType, children), records=True))


def nested_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = current_rows(table(spark, sf_dir, "relation_metrics"), "report_id", ["payload"])
    relation = _tables(reports, "relation_metrics", shred(reports, "report_id", "payload", relation_schema, parse_object, records=True))
    ends = _nested(
        spark, sf_dir, "locked_test_end_to_end_metrics", "report_id", ["metrics", "error_counts", "by_dataset"],
        {"error_counts": ("error", ()), "by_dataset": ("dataset", ()), "by_dataset[].error_counts": ("dataset_error", ())},
    )
    registry = _nested(
        spark, sf_dir, "model_registry", "registry_id", ["models"],
        {
            "models": ("model", ()), "models[].files": ("model_file", ("path",)),
            "models[].development_metrics.source_manifests": ("model_manifest", ("path",)),
            "models[].development_metrics.dictionary.excluded_by_codepoint": ("model_codepoint", ()),
        },
    )
    return relation.unionByName(ends).unionByName(registry)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_tables(spark, sf_dir).where("child <> ''").select("table_name", "record_id", "child", "parent_key", "child_key").distinct()


def p3_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that hang on the records themselves: one row per report and field, ``metrics.entity_f1`` among them."""
    rows = nested_tables(spark, sf_dir).where("child = '' AND table_name <> 'model_registry'").select("table_name", "record_id", F.explode("fields").alias("field", "value"))
    return rows.select("table_name", "record_id", "field", F.round(F.col("value").try_cast("double"), 6).alias("number")).where("number IS NOT NULL")


def p3_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, of records and of children, with their links and fields (as JSON text in key order)."""
    return nested_tables(spark, sf_dir).withColumn("fields", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields")))))


def _entries(source: str, key: str) -> str:
    """SQL: (id, parent, k, v) of the non-null entries of the JSON collections (id, parent, j) of ``source``."""
    text = "(CASE WHEN json_type(j) = 'VARCHAR' THEN (CASE WHEN json_valid(j->>'$') THEN CAST(j->>'$' AS JSON) END) ELSE j END)"
    return f"""(SELECT * FROM (SELECT id, parent, e.key AS k, e.value AS v FROM (SELECT id, parent, unnest(map_entries(CAST(j AS MAP(VARCHAR, JSON)))) AS e FROM (SELECT id, parent, {text} AS j FROM {source}) WHERE json_type(j) = 'OBJECT')
        UNION ALL SELECT id, parent, v->>'{key}' AS k, v FROM (SELECT id, parent, unnest(CAST(j AS JSON[])) AS v FROM (SELECT id, parent, {text} AS j FROM {source}) WHERE json_type(j) = 'ARRAY')) WHERE v IS NOT NULL AND json_type(v) <> 'NULL')"""


def _latest(table_name: str, key: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY recorded_at DESC, ingested_at DESC) AS i FROM {table_name} WHERE {key} IS NOT NULL) WHERE i = 1)"


QUERIES = {"p3_found": p3_found, "p3_tables": p3_tables, "p3_metrics": p3_metrics}
ORACLES = {
    "p3_found": f"""WITH rel AS (SELECT report_id AS id, CAST(payload AS JSON) AS p FROM {_latest('relation_metrics', 'report_id')} WHERE json_valid(payload)),
      pc AS (SELECT id, '' AS parent, p->'per_class' AS j FROM rel), cls AS {_entries('pc', 'class')}, bd AS (SELECT id, '' AS parent, p->'by_dataset' AS j FROM rel), dst AS {_entries('bd', 'dataset')},
      dc AS (SELECT id, k AS parent, v->'metrics'->'relation_per_class' AS j FROM dst), dcl AS {_entries('dc', 'class')}, e2e AS {_latest('locked_test_end_to_end_metrics', 'report_id')},
      ed AS (SELECT report_id AS id, e.key AS k, e.value AS v FROM (SELECT report_id, unnest(map_entries(by_dataset)) AS e FROM e2e) WHERE e.value IS NOT NULL),
      reg AS (SELECT registry_id AS id, e.key AS k, e.value AS v FROM (SELECT registry_id, unnest(map_entries(models)) AS e FROM {_latest('model_registry', 'registry_id')}) WHERE e.value IS NOT NULL)
      SELECT DISTINCT * FROM (SELECT 'relation_metrics' AS table_name, id AS record_id, 'class' AS child, parent AS parent_key, k AS child_key FROM cls UNION ALL SELECT 'relation_metrics', id, 'dataset', '', k FROM dst
        UNION ALL SELECT 'relation_metrics', id, 'dataset_class', parent, k FROM dcl
        UNION ALL SELECT 'locked_test_end_to_end_metrics', report_id, 'error', '', e.key FROM (SELECT report_id, unnest(map_entries(error_counts)) AS e FROM e2e) WHERE e.value IS NOT NULL
        UNION ALL SELECT 'locked_test_end_to_end_metrics', id, 'dataset', '', k FROM ed UNION ALL SELECT 'locked_test_end_to_end_metrics', id, 'dataset_error', k, e.key FROM (SELECT id, k, unnest(map_entries(v.error_counts)) AS e FROM ed) WHERE e.value IS NOT NULL
        UNION ALL SELECT 'model_registry', id, 'model', '', k FROM reg UNION ALL SELECT 'model_registry', id, 'model_file', k, f.path FROM (SELECT id, k, unnest(v.files) AS f FROM reg) WHERE f IS NOT NULL
        UNION ALL SELECT 'model_registry', id, 'model_manifest', k, f.path FROM (SELECT id, k, unnest(v.development_metrics.source_manifests) AS f FROM reg) WHERE f IS NOT NULL
        UNION ALL SELECT 'model_registry', id, 'model_codepoint', k, e.key FROM (SELECT id, k, unnest(map_entries(v.development_metrics.dictionary.excluded_by_codepoint)) AS e FROM reg) WHERE e.value IS NOT NULL)""",
    "p3_metrics": f"""WITH RECURSIVE rel AS (SELECT report_id AS id, CAST(payload AS JSON) AS p FROM {_latest('relation_metrics', 'report_id')} WHERE json_valid(payload)),
      t AS (SELECT id, e.key AS path, e.value AS v FROM (SELECT id, unnest(map_entries(CAST(p AS MAP(VARCHAR, JSON)))) AS e FROM rel WHERE json_type(p) = 'OBJECT') WHERE e.key NOT IN ('per_class', 'by_dataset')
        UNION ALL SELECT id, path || '.' || e.key, e.value FROM (SELECT id, path, unnest(map_entries(CAST(v AS MAP(VARCHAR, JSON)))) AS e FROM t WHERE json_type(v) = 'OBJECT')),
      e AS (SELECT report_id, unnest(['entity_f1', 'relation_f1', 'canonical_field_accuracy', 'document_type_accuracy', 'processing_time_per_page_seconds']) AS f, unnest([metrics.entity_f1, metrics.relation_f1, metrics.canonical_field_accuracy, metrics.document_type_accuracy, metrics.processing_time_per_page_seconds]) AS x FROM {_latest('locked_test_end_to_end_metrics', 'report_id')})
      SELECT 'relation_metrics' AS table_name, id AS record_id, path AS field, round(try_cast(v->>'$' AS DOUBLE), 6) AS number FROM t WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY', 'NULL') AND number IS NOT NULL
      UNION ALL SELECT 'locked_test_end_to_end_metrics', report_id, 'metrics.' || f, round(x, 6) FROM e WHERE x IS NOT NULL""",
}
