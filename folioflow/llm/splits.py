"""Splits that keep related records together: an incremental component table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.functions import sqlnames
from folioflow.functions.names import SPLITS, numbered_name, plain_name, split_name
from folioflow.llm.groups import link_keys, page_component_sql
from folioflow.operators.components import connected_components, pointer_jump
from folioflow.operators.skew import lookup_join
from folioflow.sources.tables import current_rows, table
from folioflow.storage import Versions, path_for, written

PROPORTIONS = {"train": 0.70, "validation": 0.15, "test": 0.13, "private_test": 0.02}

#: Free components are dealt out in this many hash buckets; a component larger
#: than one bucket's share is dealt out on its own (fewer than this many exist).
BUCKETS = 1024


class ComponentTable:
    """The persisted table of components, added to batch by batch.

    Every batch appends parts and commits a version (:class:`Versions`); none
    of the earlier parts is written again, and who opens ``path`` again goes on
    from the newest version.

    * ``records``: record, component at its entry
    * ``members``: node (a name, or a record without names), component at its entry
    * ``merges``: component, the one that it went into
    * ``states``: component, split, named splits, records, quarantined, state, version (the newest row holds)
    * ``quarantine``: component, version, splits that met, and the split that the whole has now
    """

    def __init__(self, spark: SparkSession, path: str, proportions: dict[str, float] | None = None):
        self.spark, self.store, self.proportions = spark, Versions(spark, path), dict(proportions or PROPORTIONS)

    @property
    def version(self) -> int:
        return self.store.newest()

    def _merged_into(self) -> DataFrame | None:
        """(component, root): where components that are no more have gone, however many merges ago."""
        merges = self.store.table("merges")
        return None if merges is None else pointer_jump(merges.select(F.col("component").alias("node"), F.col("into").alias("root"))).select(F.col("node").alias("_was"), F.col("root").alias("_now"))

    def _resolved(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the component that their ``component`` is part of now; ``rows`` is read twice."""
        into = self._merged_into()
        return rows if into is None else lookup_join(rows, "component", into, "_was").withColumn("component", F.coalesce("_now", "component")).drop("_now")

    @property
    def components(self) -> DataFrame | None:
        """The newest state of every component that is still there."""
        states = self.store.table("states")
        if states is None:
            return None
        rest = [c for c in states.columns if c != "component"]
        newest = states.groupBy("component").agg(F.max_by(F.struct(*rest), "version").alias("s")).select("component", "s.*")
        merges = self.store.table("merges")
        return newest if merges is None else newest.join(merges.select("component"), "component", "left_anti")

    def assignments(self) -> DataFrame | None:
        """(rec, component, split, named, quarantined, state) of all records of all batches."""
        records = self.store.table("records")
        if records is None:
            return None
        return lookup_join(self._resolved(records), "component", self.components.drop("version", "records").withColumnRenamed("component", "_c"), "_c", "inner")

    @property
    def members(self) -> DataFrame | None:
        """(node, component) of all nodes, with the component that they are part of now."""
        members = self.store.table("members")
        return None if members is None else self._resolved(members)

    def add(self, records: DataFrame, key: str, links: str, split: str) -> DataFrame:
        """Take in a batch and commit it; returns (key, component) of its new records.

        ``links`` is an array of names, ``split`` the split that a record names
        for itself or NULL (as is one that has no proportion).  Records sharing
        a name, directly or through other records of this or an earlier batch,
        come into one component:

        * a component of which one split is known (its own of an earlier batch,
          or one that its new records name) keeps it;
        * one of which none is known takes a split that is short of its proportion;
        * one in which different splits meet is quarantined as a whole: it keeps
          the split that most of its records have (of equals the first in the
          order of the proportions), so that no two of its records are torn
          apart, and the meeting is listed in ``quarantine``.

        Null keys are left out; records without names stand alone; records of
        an earlier batch are left as they are; an empty batch adds nothing to
        the tables.  A batch costs a scan of the members that are known, and
        writes no more than its own records and the components they touch.
        """
        version = self.store.newest()
        recs = records.where(F.col(key).isNotNull()).select(
            F.col(key).alias("rec"), F.when(F.col(split).isin(*self.proportions), F.col(split)).alias("split"), F.coalesce(links, F.array().cast("array<string>")).alias("names"),
            F.coalesce(F.try_element_at(links, F.lit(1)), F.concat(F.lit("record|"), F.col(key).cast("string"))).alias("anchor"),
        )
        if version:
            recs = recs.join(self.store.table("records").select("rec"), "rec", "left_anti")
        recs = written(recs, "records")
        edges = recs.where(F.size("names") > 1).select("anchor", F.explode(F.slice("names", F.lit(2), F.size("names") - 1)).alias("other"))
        nodes = recs.select(F.explode(F.array_union(F.array("anchor"), F.col("names"))).alias("node")).distinct()
        known = touched = None
        if version:
            known = written(self._resolved(written(self.store.table("members").join(nodes, "node", "left_semi"), "touched")), "known")
            edges = edges.unionByName(known.select(F.col("node").alias("anchor"), F.col("component").alias("other")))
        roots = written(connected_components(edges, "anchor", "other"), "roots")
        placed = written(lookup_join(recs.select("rec", "split", "anchor"), "anchor", roots, "node").select("rec", "split", F.coalesce("root", "anchor").alias("component")), "placed")
        weight = {s: f"w_{i}" for i, s in enumerate(self.proportions)}
        count = lambda n: [F.sum(F.when(F.col("split") == s, n).otherwise(0)).cast("bigint").alias(w) for s, w in weight.items()]
        parts = placed.groupBy("component").agg(*count(F.lit(1)), *[F.max(F.coalesce(F.col("split") == s, F.lit(False))).alias(f"named_{w}") for s, w in weight.items()], F.count(F.lit(1)).alias("records"), F.lit(False).alias("was"))
        if version:
            before = self.components.join(known.select("component").distinct(), "component", "left_semi")
            touched = written(before.join(roots.select(F.col("node").alias("component"), "root"), "component", "left").withColumn("root", F.coalesce("root", "component")), "before")
            own = [F.when(F.col("split") == s, F.col("records")).otherwise(0).cast("bigint").alias(w) for s, w in weight.items()]
            parts = parts.unionByName(touched.select(F.col("root").alias("component"), *own, *[F.array_contains("named", s).alias(f"named_{w}") for s, w in weight.items()], "records", F.col("quarantined").alias("was")))
        top = F.array_max(F.array(*[F.struct(F.col(w).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, (s, w) in enumerate(weight.items())]))
        met = F.array_compact(F.array(*[F.when(F.col(w) > 0, F.lit(s)) for s, w in weight.items()]))
        named = F.array_compact(F.array(*[F.when(F.max(f"named_{weight[s]}"), F.lit(s)) for s in sorted(weight)]))
        merged = parts.groupBy("component").agg(*[F.sum(w).alias(w) for w in weight.values()], named.alias("named"), F.sum("records").alias("records"), F.max("was").alias("was"))
        merged = written(merged.select("component", "records", "named", "was", met.alias("met"), F.when(top.n > 0, top.s).alias("known_split")), "merged")
        given = self._deal(merged, self.store.read(version)["facts"].get("held", {}), touched)
        torn = F.size("met") > 1
        state = F.when(F.col("was") | torn, "quarantined").when(F.col("known_split").isNotNull(), "kept").otherwise("assigned")
        states = written(given.select("component", "split", "named", "records", (F.col("was") | torn).alias("quarantined"), state.alias("state"), F.lit(version + 1).alias("version"), "met"), "states")
        held = {r["split"]: r["n"] for r in states.groupBy("split").agg(F.sum("records").alias("n")).collect()}
        if version:
            for s, n in self.store.read(version)["facts"]["held"].items():
                held[s] = held.get(s, 0) + n
            for r in touched.groupBy("split").agg(F.sum("records").alias("n")).collect():
                held[r["split"]] -= r["n"]
        fresh = nodes if known is None else nodes.join(known.select("node"), "node", "left_anti")
        adds = {
            "records": placed.select("rec", "component"), "members": fresh.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component")),
            "states": states.drop("met"), "quarantine": states.where(torn).select("component", "version", F.col("met").alias("splits"), "split"),
        }
        if version:
            adds["merges"] = touched.where("root <> component").select("component", F.col("root").alias("into"))
        self.store.add(adds, {"held": held}, version)
        return placed.select(F.col("rec").alias(key), "component")

    def _deal(self, merged: DataFrame, held: dict[str, int], touched: DataFrame | None) -> DataFrame:
        """Adds ``split``: the known one, or for a new component one that is short of records."""
        bucket = F.pmod(F.xxhash64("component"), F.lit(BUCKETS)).cast("int")
        kept = dict(held)
        for r in merged.where("known_split is not null").groupBy("known_split").agg(F.sum("records").alias("n")).collect():
            kept[r["known_split"]] = kept.get(r["known_split"], 0) + r["n"]
        for r in touched.groupBy("split").agg(F.sum("records").alias("n")).collect() if touched is not None else []:
            kept[r["split"]] -= r["n"]
        free = merged.where("known_split is null")
        waiting = free.agg(F.sum("records")).first()[0] or 0
        total = waiting + sum(kept.values())
        whole = sum(self.proportions.values())
        short = {s: p / whole * total - kept.get(s, 0) for s, p in self.proportions.items()}

        def give(n: int) -> str:
            best = max(short, key=lambda s: (short[s], s))
            short[best] -= n
            return best

        # fewer than BUCKETS components can exceed a bucket's share: a bounded list
        large = F.col("records") * BUCKETS > F.lit(waiting)
        chosen = {r["component"]: give(r["records"]) for r in sorted(free.where(large).select("component", "records").collect(), key=lambda r: (-r["records"], r["component"]))}
        rest = free.where(~large).groupBy(bucket.alias("b")).agg(F.sum("records").alias("n")).collect()
        by_bucket = {r["b"]: give(r["n"]) for r in sorted(rest, key=lambda r: (-r["n"], r["b"]))}
        one = F.broadcast(self.spark.createDataFrame(list(chosen.items()) or [("", "")], "component string, large_split string"))
        many = F.broadcast(self.spark.createDataFrame(list(by_bucket.items()) or [(-1, "")], "b int, bucket_split string"))
        dealt = merged.withColumn("b", bucket).join(one, "component", "left").join(many, "b", "left")
        return dealt.withColumn("split", F.coalesce("known_split", "large_split", "bucket_split")).drop("b", "large_split", "bucket_split")


def split_pages(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    """Current pages with their names and the split they name."""
    names = {"a": numbered_name(F.col("template_family")), "b": plain_name(F.col("split_group_id")), "c": plain_name(F.col("document_id"))}
    pages = table(spark, sf_dir, "validation").select(
        "page_id", "recorded_at", "ingested_at", link_keys("dataset", names).alias("links"), split_name(F.col("project_split")).alias("split")
    )
    return current_rows(pages, "page_id", ["links", "split", *(keep or [])])


def _in_one_batch(spark: SparkSession, sf_dir: str) -> ComponentTable:
    store = ComponentTable(spark, path_for(spark, "components"))
    store.add(split_pages(spark, sf_dir), "page_id", "links", "split")
    return store


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of components that name more than one split: the quarantined ones."""
    store = _in_one_batch(spark, sf_dir)
    torn = store.store.table("quarantine").select(F.col("component").alias("_c"))
    return lookup_join(store.store.table("records"), "component", torn, "_c", "inner").select(F.col("rec").alias("page_id"))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every current page with the split it comes out with and why."""
    return _in_one_batch(spark, sf_dir).assignments().select(F.col("rec").alias("page_id"), "split", "state")


def p1_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarantined components: which splits met, which one the whole has, and its pages."""
    store = _in_one_batch(spark, sf_dir)
    pages = store.store.table("records").groupBy("component").agg(F.min("rec").alias("first_page"), F.count(F.lit(1)).alias("pages"))
    met = store.store.table("quarantine").select("component", F.array_join(F.sort_array("splits"), ",").alias("splits"), "split")
    return met.join(pages, "component").select("first_page", "pages", "splits", "split")


def p1_batches(spark: SparkSession, sf_dir: str, batches: int = 3) -> DataFrame:
    """The splits named by every page's component after several batches (thirds of the time).

    Each batch opens the table again, as a later run would; pages arrive by the
    time of their current row, so components grow and merge on the way.
    """
    pages = written(split_pages(spark, sf_dir, keep=["recorded_at"]), "pages")
    at = F.unix_micros(F.col("recorded_at").cast("timestamp"))
    lo, hi = pages.agg(F.min(at), F.max(at)).first()
    part = F.lit(0) if lo is None else F.least(F.lit(batches - 1), F.floor((at - lo) * batches / F.lit(float(max(1, hi - lo)))))
    path = path_for(spark, "components")
    for n in range(batches):
        ComponentTable(spark, path).add(pages.where(F.coalesce(part, F.lit(0)) == n), "page_id", "links", "split")
    done = ComponentTable(spark, path).assignments()
    return done.where(F.size("named") > 0).select(F.col("rec").alias("page_id"), F.array_join("named", ",").alias("named_splits"))


assert set(PROPORTIONS) == set(SPLITS)
QUERIES = {"p1_found": p1_found, "p1_splits": p1_splits, "p1_quarantine": p1_quarantine, "p1_batches": p1_batches}
_SQL = page_component_sql({"a": sqlnames.numbered("template_family"), "b": sqlnames.plain("split_group_id"), "c": sqlnames.plain("document_id")})
ORACLES = {
    "p1_found": _SQL
    + f""" SELECT page_id FROM comp WHERE root IN (
        SELECT root FROM comp JOIN cur USING (page_id) GROUP BY root HAVING count(DISTINCT {sqlnames.split('project_split')}) > 1)""",
    "p1_quarantine": _SQL
    + f""", k AS (SELECT root, page_id, {sqlnames.split('project_split')} AS split FROM comp JOIN cur USING (page_id)), n AS (SELECT root, split, count(*) AS n FROM k WHERE split IS NOT NULL GROUP BY 1, 2),
      t AS (SELECT root, string_agg(split, ',' ORDER BY split) AS splits, arg_max(split, n * 10 - list_position(['train', 'validation', 'test', 'private_test'], split)) AS split FROM n GROUP BY 1 HAVING count(*) > 1)
      SELECT min(page_id) AS first_page, count(*) AS pages, any_value(splits) AS splits, any_value(t.split) AS split FROM k JOIN t USING (root) GROUP BY root""",
    "p1_batches": _SQL
    + f""", k AS (SELECT root, page_id, {sqlnames.split('project_split')} AS split FROM comp JOIN cur USING (page_id)), n AS (SELECT root, string_agg(DISTINCT split, ',' ORDER BY split) AS named_splits FROM k WHERE split IS NOT NULL GROUP BY 1)
      SELECT page_id, named_splits FROM k JOIN n USING (root)""",
}
