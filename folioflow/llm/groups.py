"""Consolidating pairwise matches into groups: hash-to-min."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioflow.functions import sqlnames
from folioflow.functions.names import numbered_name, plain_name
from folioflow.operators.skew import lookup_join, with_group_min
from folioflow.sources.tables import current_rows, table
from folioflow.storage import drop_written, written


def hash_to_min(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for every node of ``pairs`` the smallest node linked to it.

    Each node holds a cluster, at first itself and its neighbours.  In every
    round it sends its cluster to the cluster's smallest member and that member
    to all others; the clusters are stable when a round changes nothing.  A
    cluster is kept as rows (node, member), never as one collected value, so a
    group of any size is spread over the cluster; joins salt the hottest nodes.

    Nulls and loops link nothing, repeated pairs count once, an empty table
    gives an empty result.  Extra columns are ignored.
    """
    links = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("x"), F.col(b).alias("y"))
    # every node with itself and its neighbours
    start = links.select(F.explode(F.array(_row("x", "y"), _row("y", "x"), _row("x", "x"), _row("y", "y"))).alias("m")).select("m.node", "m.member")
    clusters = written(with_group_min(start, "node", "member", distinct=True).drop("n"), "clusters")
    state = _state(clusters)
    while True:
        sent = clusters.select(F.explode(F.array(_row("least", "member"), _row("member", "least"))).alias("m")).select("m.node", "m.member")
        nxt = written(with_group_min(sent, "node", "member", distinct=True).drop("n"), "clusters")
        after = _state(nxt)
        drop_written(clusters)
        clusters = nxt
        if after == state:
            break
        state = after
    # stable: a node's cluster is its root, or, at the root, the whole group
    return clusters.where("node <> least OR node = member").select("node", F.col("least").alias("root"))


def _row(node: str, member: str) -> Column:
    return F.struct(F.col(node).alias("node"), F.col(member).alias("member"))


def _state(clusters: DataFrame) -> tuple:
    """Number of rows and two order-free checksums of the rows."""
    sums = [F.sum(F.xxhash64(*c).cast("decimal(20,0)")) for c in (("node", "member"), ("member", "node"))]
    return tuple(clusters.agg(F.count(F.lit(1)), *sums).first())


def link_keys(scope: str, names: dict[str, Column]) -> Column:
    """Array of the non-null names of a row, each tagged by kind and scope, smallest kind first."""
    keys = [F.when(c.isNotNull(), F.concat_ws("|", F.lit(kind), plain_name(F.col(scope)), c)) for kind, c in names.items()]
    return F.array_sort(F.array_compact(F.array(*keys)))


def group_records(records: DataFrame, key: str, links: str) -> DataFrame:
    """(group_key, key) of every record that shares a link with another record.

    ``links`` is an array column of names; records that share one are matched.
    Within a record its names are chained to the first, so the graph has as
    many edges as names, not as pairs of records; the graph of names is
    consolidated by :func:`hash_to_min`.  The group is named by its smallest
    record key and includes that record.  Records without links, null keys and
    groups of one record have no row.
    """
    recs = written(records.where(F.col(key).isNotNull() & (F.size(links) > 0)).select(F.col(key).alias("rec"), F.col(links).alias("names"), F.element_at(links, 1).alias("anchor")), "records")
    edges = recs.where(F.size("names") > 1).select("anchor", F.explode(F.slice("names", F.lit(2), F.size("names") - 1)).alias("other"))
    roots = written(hash_to_min(edges, "anchor", "other"), "roots")
    flat = recs.select("rec", "anchor")
    named = written(lookup_join(flat, "anchor", roots, "node").select("rec", F.coalesce("root", "anchor").alias("root")), "named")
    grouped = with_group_min(named, "root", "rec").where("n > 1")
    return grouped.select(F.col("least").alias("group_key"), F.col("rec").alias(key))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current pages with the names of their exact, near and split groups."""
    cols = ["dataset", "exact_duplicate_group", "near_duplicate_group", "split_group_id"]
    pages = table(spark, sf_dir, "validation").select(
        "page_id", "recorded_at", "ingested_at",
        link_keys("dataset", {"e": numbered_name(F.col(cols[1])), "n": numbered_name(F.col(cols[2])), "s": plain_name(F.col(cols[3]))}).alias("links"),
    )
    return current_rows(pages, "page_id", ["links"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = group_records(page_links(spark, sf_dir), "page_id", "links")
    return out.where("page_id != group_key").select(F.col("group_key").alias("group_page_id"), "page_id")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every current page with its group identifier; an unlinked page is its own group."""
    pages = written(page_links(spark, sf_dir), "pages")
    groups = group_records(pages, "page_id", "links")
    return pages.select("page_id").join(groups, "page_id", "left").select("page_id", F.coalesce("group_key", "page_id").alias("group_page_id"))


def page_component_sql(names: dict[str, str]) -> str:
    """CTEs of a DuckDB query: cur (current pages), comp (node, root)."""
    links = " UNION ALL ".join(f"SELECT page_id, '{kind}|' || {sqlnames.plain('dataset')} || '|' || {name} AS link FROM cur WHERE {name} IS NOT NULL" for kind, name in names.items())
    return f"""WITH RECURSIVE cur AS {sqlnames.current('validation', 'page_id')}, link AS ({links}),
    edge AS (SELECT page_id AS a, link AS b FROM link UNION SELECT link, page_id FROM link),
    reach AS (SELECT page_id AS node, page_id AS page FROM cur UNION SELECT e.b, r.page FROM reach r JOIN edge e ON e.a = r.node),
    comp AS (SELECT node AS page_id, min(page) AS root FROM reach WHERE node IN (SELECT page_id FROM cur) GROUP BY node)"""


_SQL = page_component_sql({"e": sqlnames.numbered("exact_duplicate_group"), "n": sqlnames.numbered("near_duplicate_group"), "s": sqlnames.plain("split_group_id")})
QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
ORACLES = {
    "p2_found": _SQL + " SELECT root AS group_page_id, page_id FROM comp WHERE root <> page_id",
    "p2_groups": _SQL + " SELECT page_id, root AS group_page_id FROM comp",
}
