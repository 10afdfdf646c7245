"""Schemas that drift between files: every change, and one consistent table.

Each file is profiled field by field (type, value sketch); consecutive files of
a stream are compared; fields that go and fields that come below one parent
are matched as a bipartite graph by name, type and value similarity, and a
matched pair is a rename.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioflow.operators.components import connected_components
from folioflow.storage import written

CHANGES = "stream string, report_id bigint, earlier_id bigint, field_path string, change_kind string, new_path string, score double"
#: Matches scoring less are still renames of that file, but don't unify columns.
SAME_COLUMN = 0.5
#: Where several fields go or come below one parent, a matched pair that scores
#: less is a field removed and another added; one for one is always a rename.
SAME_FIELD = 0.3


def kind_of(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def sketch_of(v) -> str:
    """A short text that similar values share: magnitude, first words, names or size."""
    k = kind_of(v)
    if k == "number":
        return f"{v:.1e}" if not isinstance(v, int) or abs(v) < 10**15 else "huge"
    if k == "string":
        return v[:24].lower()
    if k == "array":
        return f"{len(v)}:" + (kind_of(v[0]) if v else "")
    return " ".join(sorted(v)[:6]) if k == "object" else str(v)


def profile(value: dict, opaque: frozenset[str]) -> dict:
    """name -> [type, sketch, fields below or None]; opaque fields have none below."""
    return {n: [kind_of(v), sketch_of(v), profile(v, opaque) if isinstance(v, dict) and n not in opaque else None] for n, v in value.items()}


@lru_cache(maxsize=100_000)
def name_similarity(a: str, b: str) -> float:
    return SequenceMatcher(None, a.lower().replace("_", ""), b.lower().replace("_", "")).ratio()


def similarity(a: str, old: list, b: str, new: list) -> float:
    """0..1: half by name, a quarter by type, a quarter by the value sketch."""
    kind = 1.0 if old[0] == new[0] else 0.5 if "null" in (old[0], new[0]) else 0.0
    return 0.5 * name_similarity(a, b) + 0.25 * kind + 0.25 * (1.0 if old[1] == new[1] else SequenceMatcher(None, old[1], new[1]).ratio() * 0.8)


def assign(weight: list[list[float]]) -> list[tuple[int, int]]:
    """Maximum-weight matching of rows to columns (Hungarian method); every row or every column is matched."""
    n, m = len(weight), len(weight[0]) if weight else 0
    if n > m:
        return [(i, j) for j, i in assign([list(c) for c in zip(*weight)])]
    u, v, match = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)  # whole numbers stay exact
    for i in range(1, n + 1):
        match[0], j0, best, back, used = i, 0, [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while match[j0]:
            used[j0] = True
            i0, step, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    cost = -weight[i0 - 1][j - 1] - u[i0] - v[j]
                    if cost < best[j]:
                        best[j], back[j] = cost, j0
                    if best[j] < step:
                        step, j1 = best[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    best[j] -= step
            j0 = j1
        while j0:
            match[j0] = match[back[j0]]
            j0 = back[j0]
    return sorted((match[j] - 1, j - 1) for j in range(1, m + 1) if match[j])


def _fresh(entry: list, known: str | None = None) -> list:
    """A state entry [type, sketch, fields, present]; a null takes the type known before."""
    below = {n: _fresh(e) for n, e in entry[2].items()} if entry[2] is not None else None
    return [known if entry[0] == "null" and known else entry[0], entry[1], below, 1]


def advance(state: dict, cur: dict, path: tuple[str, ...], changes: list, least: float = SAME_FIELD) -> dict:
    """The state after a file; appends (path, kind, new path, score) for each change.

    Fields that are gone stay in the state as absent, with the type last seen.
    """
    goes = [n for n, e in state.items() if e[3] and n not in cur]
    comes = [n for n in cur if n not in state or not state[n][3]]
    renamed: dict[str, str] = {}
    if goes and comes:
        weight = [[similarity(a, state[a], b, cur[b]) for b in comes] for a in goes]
        pairs = assign(weight)
        if len(goes) + len(comes) > 2:
            pairs = [(i, j) for i, j in pairs if weight[i][j] >= least]
        for i, j in pairs:
            renamed[comes[j]] = goes[i]
            changes.append(((*path, goes[i]), "renamed", (*path, comes[j]), weight[i][j]))
    left = set(renamed.values())
    for n in goes:
        if n not in left:
            changes.append(((*path, n), "removed", None, None))
    new = {n: [*e[:3], 0] for n, e in state.items() if n not in cur}
    for n, entry in cur.items():
        old = state.get(n)
        if n in renamed:
            new[n] = _fresh(entry, state[renamed[n]][0])
        elif old is None or not old[3]:
            changes.append(((*path, n), "added", None, None))
            new[n] = _fresh(entry, old and old[0])
        elif entry[0] == "null":
            new[n] = old
        elif old[0] not in ("null", entry[0]):
            changes.append(((*path, n), "type", None, None))
            new[n] = _fresh(entry)
        elif entry[2] is not None and old[2] is not None:
            new[n] = [entry[0], entry[1], advance(old[2], entry[2], (*path, n), changes, least), 1]
        else:
            new[n] = _fresh(entry)
    return new


def profiles(files: DataFrame, stream: str, order: str, report_id: str, payload: str, parse, opaque: tuple[str, ...]) -> DataFrame:
    """(stream, at, report_id, profile) of the files whose payload is a valid object."""
    rows = files.where(F.col(report_id).isNotNull()).select(F.col(stream).alias("stream"), F.col(order).alias("at"), F.col(report_id).cast("bigint").alias("report_id"), F.col(payload).alias("payload"))
    hidden = frozenset(opaque)
    schema = rows.select("stream", "at", "report_id").schema.add("profile", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = [parse(x) for x in b.column(3).to_pylist()]
            texts = [None if p is None else json.dumps(profile(p, hidden)) for p in parsed]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(texts, pa.string())], names=["stream", "at", "report_id", "profile"])

    return rows.mapInArrow(run, schema).where("profile IS NOT NULL")


def schema_changes(profiled: DataFrame) -> DataFrame:
    """Every change between consecutive files of a stream, in any number of partitions.

    Files are ordered by ``at`` and then id and cut into ranges of that order,
    so a stream that holds most of the files is spread over many tasks.  A first
    pass gives the state at the end of each range; the driver joins these (one
    per range, each the size of one file's schema) and hands every range the
    state before it; a second pass lists the changes.  A stream's first file
    changes nothing; a null stream is a stream of its own; an empty table gives
    no changes.
    """
    order = ["stream", "at", "report_id"]
    ranged = written(profiled.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")

    def walk(pdf: pd.DataFrame, state: dict | None, emit: list | None) -> dict | None:
        """Runs through one stream's files; state None: before its first file."""
        earlier = None if state is None else state["id"]
        fields = None if state is None else state["fields"]
        for rid, text in zip(pdf["report_id"], pdf["profile"]):
            cur = json.loads(text)
            if fields is None:
                fields = {n: _fresh(e) for n, e in cur.items()}
            else:
                changes: list = []
                fields = advance(fields, cur, (), changes)
                if emit is not None:
                    emit.extend((int(rid), earlier, ".".join(p), kind, ".".join(q) if q else None, s) for p, kind, q, s in changes)
            earlier = int(rid)
        return None if fields is None else {"id": earlier, "fields": fields}

    def streams(pdf: pd.DataFrame) -> list[tuple[str | None, pd.DataFrame]]:
        pdf = pdf.sort_values(order, na_position="first", kind="stable")
        key = pdf["stream"].fillna("\0")
        return [(None if k == "\0" else k, g) for k, g in pdf.groupby(key, sort=False)]

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = streams(pdf)
        name, last = groups[-1]
        return pd.DataFrame({"part": [int(pdf["_part"].iloc[0])], "first": [groups[0][0]], "last": [name], "alone": [len(groups) == 1], "state": [json.dumps(walk(last, None, None))]})

    bounds = ranged.groupBy("_part").applyInPandas(ends, "part int, first string, last string, alone boolean, state string").orderBy("part").collect()
    carry: dict[int, str] = {}
    before: dict | None = None
    before_stream: str | None = None
    for b in bounds:
        joins = before is not None and b["first"] == before_stream
        if joins:
            carry[b["part"]] = json.dumps(before)
        end = json.loads(b["state"])
        if joins and b["alone"]:
            end["fields"] = _overlay(before["fields"], end["fields"])
        before, before_stream = end, b["last"]

    def changes(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list = []
        start = carry.get(int(pdf["_part"].iloc[0]))
        for i, (name, files) in enumerate(streams(pdf)):
            found: list = []
            walk(files, json.loads(start) if start and i == 0 else None, found)
            rows.extend((name, *f) for f in found)
        return pd.DataFrame(rows, columns=["stream", "report_id", "earlier_id", "field_path", "change_kind", "new_path", "score"])

    return ranged.groupBy("_part").applyInPandas(changes, CHANGES)


def _overlay(before: dict, after: dict) -> dict:
    """The state of a range that knew nothing of the files before it, with their types."""
    out = {n: [*e[:3], 0] for n, e in before.items() if n not in after}
    for n, e in after.items():
        old = before.get(n)
        if old is None:
            out[n] = e
        elif e[0] == "null":
            out[n] = [*old[:3], e[3]]
        elif e[2] is not None and old[2] is not None and e[0] == old[0]:
            out[n] = [e[0], e[1], _overlay(old[2], e[2]), e[3]]
        else:
            out[n] = e
    return out


def unified_names(changes: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, column): the name under which a path's values are unified.

    Paths joined by renames that score at least SAME_COLUMN are one column,
    named by the path that most files use.  Both inputs are the size of the
    schema's vocabulary, not of the data.
    """
    pairs = changes.where((F.col("change_kind") == "renamed") & (F.col("score") >= SAME_COLUMN)).select("field_path", "new_path").distinct()
    roots = connected_components(pairs, "field_path", "new_path")
    counted = paths.join(roots, paths["path"] == roots["node"], "left").select("path", "files", F.coalesce("root", "path").alias("root"))
    best = counted.groupBy("root").agg(F.max_by("path", F.struct("files", "path")).alias("column"))
    return counted.join(best, "root").select("path", "column")
