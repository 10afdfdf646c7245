"""Inventory audits: duplicates, pairing, prefixes, near-duplicates, summaries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioflow.operators.components import connected_components
from folioflow.operators.skew import SALTS, lookup_join, with_group_min
from folioflow.storage import drop_written, written

SHINGLE_WORDS = 5
#: So many of the most frequent shingles are told to every worker: a bound that doesn't grow.
HOT_SHINGLES = 1 << 18
ROWS = 256


def exact_duplicates(rows: DataFrame, digest: str) -> DataFrame:
    """(digest, n) of non-empty digests that several rows share."""
    return rows.where((F.col(digest) != "") & F.col(digest).isNotNull()).groupBy(digest).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_report(rows: DataFrame, digest: str, scope: str, key: str) -> DataFrame:
    """Members of every duplicate group with its canonical row and whether it crosses scopes.

    The group's figures are aggregated first and joined back, hot digests
    salted, so no task holds a whole group.
    """
    kept = written(rows.where((F.col(digest) != "") & F.col(digest).isNotNull()).select(digest, scope, key), "members")
    groups = kept.groupBy(F.col(digest).alias("_d")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(scope, key)).alias("_c"), (F.min(scope) != F.max(scope)).alias("crosses")).where("n > 1")
    out = lookup_join(kept, digest, groups, "_d", "inner")
    return out.select(digest, scope, key, "n", F.col(f"_c.{key}").alias("canonical"), "crosses", ((F.col(scope) == F.col(f"_c.{scope}")) & (F.col(key) == F.col(f"_c.{key}"))).alias("is_canonical"))


def unpaired(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str]) -> DataFrame:
    """Keys that only one side has, with the side that is missing."""
    l, r = left.select(*keys).distinct(), right.select(*keys).distinct()
    return l.join(r, keys, "left_anti").withColumn("missing", F.lit(names[1])).unionByName(r.join(l, keys, "left_anti").withColumn("missing", F.lit(names[0])))


def longest_prefix(rows: DataFrame, key: str, stems: DataFrame, stem: str, sep: str = "_") -> DataFrame:
    """Each key with the longest of its ``sep``-prefixes that is a stem (NULL where none is)."""
    parts = F.split(key, sep)
    prefixes = rows.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), sep))).alias("_p"))
    hit = prefixes.join(stems.select(F.col(stem).alias("_p")).distinct(), "_p").groupBy(key).agg(F.max_by("_p", F.length("_p")).alias("matched"))
    return rows.select(key).distinct().join(hit, key, "left")


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct five-word shingles of each text as sorted 64-bit hashes (all its words as one where it has fewer)."""
    words = [(t or "").lower().split() for t in texts]
    parts = [[" ".join(w[i : i + SHINGLE_WORDS]) for i in range(max(1, len(w) - SHINGLE_WORDS + 1))] if w else [] for w in words]
    flat = np.empty(sum(map(len, parts)), dtype=object)
    flat[:] = [x for p in parts for x in p]
    hashes = pd.util.hash_array(flat, categorize=False).view(np.int64)
    ends = np.cumsum([0, *map(len, parts)])
    return [np.unique(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def _kernel(rows: DataFrame, schema: T.StructType, made: Callable[[np.ndarray], tuple]) -> DataFrame:
    """(key, made...): what ``made`` gives for the shingle set of each (key, text), in slices of ROWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = None
        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                to = to or to_arrow_schema(schema)
                out = list(zip(*[made(s) for s in shingle_sets(b.column(1).to_pylist())]))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(to.field(0).type), *[pa.array(v, f.type) for v, f in zip(out, list(to)[1:])]], names=to.names)

    return rows.mapInArrow(run, schema)


def near_text_groups(rows: DataFrame, key: str, text: str, cell: int = 512) -> DataFrame:
    """(key, group): rows linked by texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    Equal sets are one class and are compared once.  In one fixed order of all
    shingles (the frequent ones last), two sets that similar share one of the
    first n - ceil(0.8 n) + 1 of each, so no pair is missed; pairs that share
    one and whose sizes, places and parity bits allow the similarity are then
    compared shingle by shingle.  The frequencies come from a sixteenth of the rows and
    steer the order only, never which pairs there are.  A shingle in many
    prefixes is spread over a grid of cells of about ``cell`` rows.  Shingles
    are told apart by 64-bit hashes.  Texts without words stay alone.
    """
    spark = rows.sparkSession
    texts = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    field = T.StructType([texts.schema["key"]])
    drawn = texts.where((F.pmod(F.xxhash64("key"), F.lit(16)) == 0) & F.col("text").isNotNull())
    counts = _kernel(drawn, T.StructType([*field, T.StructField("s", T.ArrayType(T.LongType()))]), lambda s: (s,)).select(F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = counts.orderBy(F.desc("n"), "s").limit(HOT_SHINGLES).toArrow()
    by = np.argsort(values := hot["s"].to_numpy())
    shared = spark.sparkContext.broadcast((values[by], hot["n"].to_numpy()[by]))

    def prefix(s: np.ndarray) -> tuple:
        if not len(s):
            return None, 0, [], []
        known, often = shared.value
        n = np.zeros(len(s), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            n = np.where(known[at] == s, often[at], 0)
        return hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), s[np.lexsort((s, n))[: len(s) - -(-4 * len(s) // 5) + 1]], np.packbits(np.bincount(s & 255, minlength=256) & 1).view(np.int64)

    made = written(_kernel(texts, T.StructType([*field, T.StructField("digest", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType()))]), prefix), "shingles")
    classes = written(made.where("digest IS NOT NULL").groupBy("digest").agg(F.min("key").alias("head"), F.first("n").alias("size"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")), "classes")
    first = classes.select(F.col("head"), "size", F.posexplode("prefix").alias("at", "s"))
    seen = with_group_min(first, "s", "head").where("n > 1").withColumn("g", F.ceil(F.col("n") / cell)).withColumn("cell", F.pmod(F.xxhash64("head"), F.col("g")))
    seen = written(seen.select("s", "head", "size", "at", "g", "cell"), "prefixes")
    grid = seen.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))).withColumns({"lo": F.least("cell", "k"), "hi": F.greatest("cell", "k")}).drop("k", "g")
    a, b = grid.alias("a"), grid.alias("b")
    most = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))  # of shingles in common, if this is the first
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("s", "lo", "hi")] + [F.col("a.head") < F.col("b.head"), (F.col("a.lo") == F.col("a.hi")) | (F.col("a.cell") != F.col("b.cell")), 9 * most >= 4 * (F.col("a.size") + F.col("b.size"))]
    pairs = written(a.join(b, on).select(F.col("a.head").alias("x"), F.col("b.head").alias("y")).distinct(), "pairs")
    # a bit per residue of the hashes, set by an odd number of them: sets differ in at least as many shingles as bits
    sketch = lambda n: classes.select("head", F.struct("size", "bits").alias(n))
    half = written(lookup_join(pairs, "x", sketch("u"), "head", "inner"), "half")
    apart = F.aggregate(F.zip_with("u.bits", "v.bits", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, n: acc + n)
    kept = written(lookup_join(half, "y", sketch("v"), "head", "inner").where(9 * apart <= F.col("u.size") + F.col("v.size")).select("x", "y").distinct(), "kept")
    wanted = kept.select(F.explode(F.array("x", "y")).alias("key")).distinct()
    sets = written(_kernel(texts.join(wanted, "key", "left_semi"), T.StructType([*field, T.StructField("s", T.ArrayType(T.LongType()))]), lambda s: (s,)), "sets")
    left = written(lookup_join(kept, "x", sets.select("key", F.col("s").alias("sx")), "key", "inner"), "left")
    both = lookup_join(left, "y", sets.select("key", F.col("s").alias("sy")), "key", "inner", F.pmod(F.xxhash64("x"), F.lit(SALTS)))
    links = both.where(9 * F.size(F.array_intersect("sx", "sy")) >= 4 * (F.size("sx") + F.size("sy"))).select("x", "y")
    roots = connected_components(links, "x", "y")
    heads = written(lookup_join(classes.select("digest", "head"), "head", roots.withColumnRenamed("node", "_node"), "_node").select(F.col("digest").alias("_d"), F.coalesce("root", "head").alias("_group")), "heads")
    drop_written(classes, seen, pairs, half, kept, sets, left)
    return lookup_join(made.select("key", "digest"), "digest", heads, "_d").select(F.col("key").alias(key), F.coalesce("_group", "key").alias("group"))


def hamming_groups(rows: DataFrame, key: str, hash64: str, radius: int = 5, blocks: int = 8, buckets: tuple[str, ...] = ()) -> DataFrame:
    """(key, group): rows linked by hashes that differ in at most ``radius`` bits.

    Equal hashes are one class and are compared once; classes that agree in
    some ``blocks - radius`` blocks are the only ones that can be near
    (pigeonhole), and are then compared exactly.  Links are consolidated, so
    the output has one row per key, whatever the number of pairs.  ``buckets``
    are columns that must be equal (page sizes, say).  Null hashes stay alone.
    """
    classes = written(rows.where(F.col(hash64).isNotNull()).groupBy(hash64, *buckets).agg(F.min(key).alias("head")), "classes")
    width = 64 // blocks
    part = [F.shiftrightunsigned(F.col(hash64), i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(blocks)]
    picks = F.array(*[F.struct(F.lit(n).alias("pick"), F.concat_ws(".", *[part[i].cast("string") for i in c]).alias("bits")) for n, c in enumerate(combinations(range(blocks), blocks - radius))])
    banded = classes.select("*", F.explode(picks).alias("p"))
    a, b = banded.alias("a"), banded.alias("b")
    on = [F.col("a.p") == F.col("b.p"), F.col("a.head") < F.col("b.head")] + [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in buckets]
    near = F.bit_count(F.col(f"a.{hash64}").bitwiseXOR(F.col(f"b.{hash64}"))) <= radius
    links = a.join(b, on).where(near).select(F.col("a.head").alias("x"), F.col("b.head").alias("y")).distinct()
    roots = connected_components(links, "x", "y")
    heads = classes.join(roots, classes["head"] == roots["node"], "left").select(hash64, *buckets, F.coalesce("root", "head").alias("_group"))
    eq = rows.alias("r").join(heads.alias("h"), [F.col(f"r.{hash64}") == F.col(f"h.{hash64}")] + [F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}")) for c in buckets], "left")
    return eq.select(F.col(f"r.{key}").alias(key), F.coalesce("_group", F.col(f"r.{key}")).alias("group"))


def histogram(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """Per ``by`` a map value -> count, from counts and not from collected rows."""
    counts = rows.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce(column, F.lit("")), "_n")))).alias("histogram"))


def leakage(rows: DataFrame, split: str, identities: dict[str, Column]) -> DataFrame:
    """(kind, identity, splits) of identities that occur in more than one split."""
    each = rows.select(split, F.explode(F.array_compact(F.array(*[F.when(c.isNotNull() & (c != ""), F.struct(F.lit(k).alias("kind"), c.alias("identity"))) for k, c in identities.items()]))).alias("i"))
    return each.where(F.col(split).isNotNull()).groupBy("i.kind", "i.identity").agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def deal_components(sizes: DataFrame, key: str, size: str, proportions: dict[str, float], buckets: int = 1024) -> DataFrame:
    """(key, size, split): whole components dealt out so that rows meet the proportions.

    Components larger than one bucket's share are fewer than ``buckets`` and are
    placed one by one, largest first, where most is missing; all others go by
    hash bucket, so the loop on the driver has a fixed length.
    """
    total = sizes.agg(F.sum(size)).first()[0] or 0
    short = {s: p / sum(proportions.values()) * total for s, p in proportions.items()}
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    large = F.col(size) * buckets > total
    place: dict = {}

    def give(n: int) -> str:
        best = max(short, key=lambda s: (short[s], s))
        short[best] -= n
        return best

    for r in sorted(sizes.where(large).select(key, size).collect(), key=lambda r: (-r[1], str(r[0]))):
        place[r[0]] = give(r[1])
    rest = {r[0]: give(r[1]) for r in sorted(sizes.where(~large).groupBy(bucket.alias("b")).agg(F.sum(size)).collect(), key=lambda r: (-r[1], r[0]))}
    spark = sizes.sparkSession
    one = spark.createDataFrame(list(place.items()), spark.createDataFrame([], sizes.select(key).schema.add("_one", "string")).schema)
    many = spark.createDataFrame(list(rest.items()) or [(-1, "")], "_b int, _many string")
    return sizes.withColumn("_b", bucket).join(F.broadcast(one), key, "left").join(F.broadcast(many), "_b", "left").select(key, size, F.coalesce("_one", "_many").alias("split"))
