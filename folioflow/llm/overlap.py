"""Same or near-same records across splits: winnowing fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioflow.functions import sqlnames
from folioflow.functions.names import numbered_name, plain_name, split_name
from folioflow.llm.leaks import _mix
from folioflow.operators.skew import SALTS, lookup_join, pairs_join
from folioflow.sources.tables import current_rows, table
from folioflow.storage import written

TRAIN = "train"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty array for null or blank text."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}\p{M}]+)"), 1), F.array())


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k tokens (of the whole sequence where it is shorter)."""
    k = min(k, len(codes))
    if not k:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(codes) - k + 1, np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(0x100000001B3) + codes[i : len(codes) - k + 1 + i].view(np.uint64))
    return h


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the selected fingerprints: the minimum of every w consecutive hashes.

    The rightmost minimum of a window is taken and named once, so any shared
    run of k + w - 1 tokens has a fingerprint in common (Schleimer, Wilkerson
    and Aiken).  With w = 1 every hash is selected.
    """
    w = min(w, len(hashes))
    if w <= 1:
        return np.arange(len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, w)
    return np.unique(np.arange(len(views)) + w - 1 - views[:, ::-1].argmin(1))


def text_classes(records: DataFrame, key: str, tokens: str, split: str, source: str | None, scope: str | None) -> tuple[DataFrame, DataFrame]:
    """(members, classes): records by the sequence of their tokens.

    ``members``: key, class, split, source.  ``classes``: class, head (the
    smallest key), codes (64-bit hashes of the tokens), scope, and whether the
    class has members in train and in another split.  Equal sequences of one
    scope are one class, so copies are fingerprinted and compared once.
    """
    own = F.md5(F.concat_ws("\x1e", (F.col(scope) if scope else F.lit("")), F.concat_ws("\x1f", tokens)).cast("binary"))
    rows = records.where(F.col(key).isNotNull() & F.col(split).isNotNull() & (F.size(tokens) > 0)).select(
        F.col(key).alias("key"), own.alias("class"), F.col(split).alias("split"), (F.col(source) if source else F.lit(None).cast("string")).alias("source"),
        (F.col(scope).cast("string") if scope else F.lit("")).alias("scope"), F.transform(tokens, lambda t: F.xxhash64(t)).alias("codes"),
    )
    rows = written(rows, "records")
    train = F.col("split") == TRAIN
    classes = rows.groupBy("class").agg(F.min("key").alias("head"), F.first("codes").alias("codes"), F.min("scope").alias("scope"), F.max(train).alias("t"), F.max(~train).alias("e"))
    return rows.drop("codes", "scope"), written(classes, "classes")


def fingerprints(classes: DataFrame, k: int, w: int) -> DataFrame:
    """One row per selected fingerprint: class, t, e, n, its hash (with the scope) and its place; no text goes along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            codes = whole.column(0)
            flat, ends = codes.values.to_numpy(), codes.offsets.to_numpy()
            every = [gram_hashes(flat[i:j], k) for i, j in zip(ends[:-1], ends[1:])]
            found = [winnow(h, w) for h in every]
            hashes = [h[f] for h, f in zip(every, found)]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            at = pa.array(np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32))
            h = pa.array(np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*[whole.column(c).take(row) for c in range(1, 6)], h, at], names=["class", "t", "e", "scope", "n", "h", "at"])

    made = classes.select("codes", "class", "t", "e", "scope", F.size("codes").alias("n")).mapInArrow(run, "class string, t boolean, e boolean, scope string, n int, h bigint, at int")
    return made.select("class", "t", "e", "n", F.xxhash64("h", "scope").alias("g"), "at")


def seeds_needed(n: Column, coverage: float, k: int, w: int) -> Column:
    """At least so many fingerprints of a record of n tokens are shared where stretches of k + w - 1 tokens or more cover ``coverage`` of it.

    A stretch of L tokens has L - k + 1 hashes, so floor((L - k + 1) / w)
    windows of their own, each with a fingerprint; per token that is least for
    L = k + 2w - 2.
    """
    return F.ceil(F.lit(coverage) * n / F.lit(k + 2 * w - 2)).cast("int")


def candidate_pairs(classes: DataFrame, k: int, w: int, coverage: float) -> DataFrame:
    """(eval, train): classes that share as many fingerprints as the coverage takes, never fewer.

    Fingerprints of one side only are dropped first.  An evaluation class has
    to share m of its F fingerprints, so it shares r of its F - m + r rarest,
    whichever they are: the most frequent m - r (phrases that half the corpus
    has) are not looked up, and no pair is lost.  r is half of m.
    """
    prints = written(fingerprints(classes, k, w), "prints")
    both = prints.groupBy("g").agg(F.max("t").alias("_t"), F.max("e").alias("_e"), F.count(F.lit(1)).alias("often")).where("_t AND _e").select(F.col("g").alias("_g"), "often")
    shared = written(lookup_join(prints, "g", both, "_g", "inner"), "shared")
    m = F.greatest(F.lit(1), seeds_needed(F.col("n"), coverage, k, w))
    r = F.ceil(m / 2).cast("int")
    whole = prints.where("e").groupBy(F.col("class").alias("_class")).agg(F.count(F.lit(1)).alias("_all"))
    # of F fingerprints those that nobody else has are the rarest; they are not in ``shared``
    ranked = shared.where("e").groupBy("class").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("often", "g", "at"))).alias("f")).join(whole, F.col("class") == F.col("_class"))
    asked = ranked.select(F.col("class").alias("eval"), r.alias("r"), F.explode(F.slice("f", F.lit(1), F.greatest(F.lit(0), F.size("f") - (m - r)))).alias("x")).select("eval", "r", F.col("x.g").alias("g"), F.col("x.at").alias("at"))
    there = shared.where("t").select("g", F.col("class").alias("train")).distinct()
    pairs = pairs_join(there, written(asked, "asked"), "g", shared.select("g", "class", "at"), F.pmod(F.xxhash64("train"), F.lit(SALTS)))
    found = pairs.where("eval <> train").groupBy("eval", "train").agg(F.count_distinct("at").alias("_n"), F.max("r").alias("_r")).where("_n >= _r").select("eval", "train")
    return found.unionByName(classes.where("t AND e").select(F.col("class").alias("eval"), F.col("class").alias("train")))


def stretches(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Maximal equal runs of at least k tokens (or of the whole of a, if that is shorter), as rows (place in a, place in b, length)."""
    k = min(k, len(a))
    if len(b) < k:
        return np.zeros((0, 3), np.int64)
    grams = [gram_hashes(x, k) for x in (a, b)]
    order = np.argsort(grams[1], kind="stable")
    lo, hi = (np.searchsorted(grams[1][order], grams[0], side) for side in ("left", "right"))
    n = hi - lo
    i = np.repeat(np.arange(len(n)), n)
    j = order[np.repeat(lo, n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(j - i) != 0) | (np.diff(i) > 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i)) - 1
    runs = np.stack([i[first], j[first], i[last] - i[first] + k], axis=1) if len(i) else np.zeros((0, 3), np.int64)
    return runs[[bool((a[x : x + n] == b[y : y + n]).all()) for x, y, n in runs]] if len(runs) else runs  # hashes may collide


def chained(runs: np.ndarray) -> int:
    """Tokens of a that the best collinear chain of runs covers.

    A run follows another if it begins and ends after it in both texts; what
    overlaps in either counts once.  The best chain ending in each run is found
    from all runs before it, not from the first that fits.
    """
    if not len(runs):
        return 0
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    x, y, n = runs.T
    best = n.copy()
    for q in range(1, len(runs)):
        fresh = n[q] - np.maximum(0, np.maximum(x[:q] + n[:q] - x[q], y[:q] + n[:q] - y[q]))
        ok = (x[:q] < x[q]) & (y[:q] < y[q]) & (fresh > 0)
        if ok.any():
            best[q] = max(best[q], int((best[:q] + fresh)[ok].max()))
    return int(best.max())


def class_overlaps(classes: DataFrame, k: int, w: int, least: int, coverage: float) -> DataFrame:
    """(eval, train, covered, n): pairs of classes, aligned and kept if they cover enough."""
    pairs = written(candidate_pairs(classes, k, w, coverage), "pairs")
    codes = lambda c: classes.select(F.col("class").alias("_c"), F.col("codes").alias(c))
    half = written(lookup_join(pairs, "eval", codes("a"), "_c", "inner"), "half")
    both = lookup_join(half, "train", codes("b"), "_c", "inner", F.pmod(F.xxhash64("eval"), F.lit(SALTS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            a, b = whole.column("a"), whole.column("b")
            covered = np.zeros(whole.num_rows, np.int32)
            sizes = np.zeros(whole.num_rows, np.int32)
            for i in range(whole.num_rows):
                x, y = a[i].values.to_numpy(), b[i].values.to_numpy()
                sizes[i] = len(x)
                covered[i] = len(x) if len(x) == len(y) and (x == y).all() else chained(stretches(x, y, k))
            yield pa.RecordBatch.from_arrays([whole.column("eval"), whole.column("train"), pa.array(covered), pa.array(sizes)], names=["eval", "train", "covered", "n"])

    found = both.select("eval", "train", "a", "b").mapInArrow(run, "eval string, train string, covered int, n int")
    return written(found.where((F.col("covered") >= F.least(F.lit(least), F.col("n"))) & (F.col("covered") >= F.lit(coverage) * F.col("n"))), "overlaps")


def cross_split_classes(records: DataFrame, key: str, tokens: str, split: str, source: str | None = None, k: int = 5, w: int = 4, least: int | None = None, coverage: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): overlaps of evaluation texts with train texts, copies folded.

    ``pairs``: eval_class, train_class (named by their smallest key), covered,
    coverage; ``members``: key, class, split, source of every record that has
    tokens and a split.  No pair of copies is written out.
    """
    members, classes = text_classes(records, key, tokens, split, source, None)
    found = class_overlaps(classes, k, w, k if least is None else least, coverage)
    head = lambda name: classes.select(F.col("class").alias("_c"), F.col("head").alias(name))
    named = lookup_join(written(lookup_join(found, "eval", head("eval_class"), "_c", "inner"), "named"), "train", head("train_class"), "_c", "inner")
    pairs = named.select("eval_class", "train_class", "covered", (F.col("covered") / F.col("n")).alias("coverage"))
    return pairs, lookup_join(members, "class", head("_head"), "_c", "inner").select("key", F.col("_head").alias("class"), "split", "source")


def cross_split_overlaps(
    records: DataFrame, key: str, tokens: str, split: str, source: str | None = None, k: int = 5, w: int = 4, least: int | None = None, scope: str | None = None, coverage: float = 0.0
) -> DataFrame:
    """Overlaps of evaluation records with train records, one row per pair of records.

    ``train_key, eval_key, eval_split, source, covered, coverage`` — the tokens
    of the evaluation record that lie in the chained stretches, as a number and
    as a share of its tokens.  Candidates are classes of equal sequences that
    share winnowed fingerprints; all equal runs of k tokens of a candidate are
    extended to maximal stretches and the best collinear chain is taken.
    Pairs with fewer than ``least`` covered tokens (k by default), or less than
    the share ``coverage``, are dropped.  ``scope`` restricts pairs to equal
    values of that column.  A stretch of k + w - 1 tokens is sure to be found;
    with ``coverage`` the guarantee holds for records that such stretches cover
    to that share.

    Null keys, null or empty token arrays and rows without a split pair with
    nothing.  Repeated tokens are kept in place.  Output rows are as many as
    there are overlapping pairs; :func:`cross_split_classes` gives the same by
    classes of copies.
    """
    members, classes = text_classes(records, key, tokens, split, source, scope)
    found = class_overlaps(classes, k, w, k if least is None else least, coverage)
    train = members.where(F.col("split") == TRAIN).select(F.col("key").alias("train_key"), F.col("class").alias("train"))
    own = members.where(F.col("split") != TRAIN).select(F.col("key").alias("eval_key"), F.col("class").alias("eval"), F.col("split").alias("eval_split"), "source")
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS))
    left = written(pairs_join(own, found, "eval", members.select(F.col("class").alias("eval"), "key"), salt("eval_key")), "left")
    out = pairs_join(left, train, "train", members.select(F.col("class").alias("train"), "key"), salt("eval_key"))
    return out.select("train_key", "eval_key", "eval_split", "source", "covered", (F.col("covered") / F.col("n")).alias("coverage"))


def group_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current pages as token sequences: the names of their exact and near groups.

    The manifest holds no text; what a page shares with another is named by
    its groups, so its sequence has one token per group it is in.
    """
    token = lambda kind, c: F.concat(F.lit(kind), numbered_name(F.col(c)))
    pages = table(spark, sf_dir, "validation").select(
        "page_id", "recorded_at", "ingested_at", plain_name(F.col("dataset")).alias("dataset"), split_name(F.col("project_split")).alias("split"),
        F.array_compact(F.array(token("exact|", "exact_duplicate_group"), token("near|", "near_duplicate_group"))).alias("tokens"),
    )
    return current_rows(pages, "page_id", ["dataset", "split", "tokens"]).where("split IS NOT NULL AND size(tokens) > 0")


def page_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split_overlaps(group_tokens(spark, sf_dir), "page_id", "tokens", "split", source="dataset", k=1, w=1, scope="dataset")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_overlaps(spark, sf_dir).select(F.least("train_key", "eval_key").alias("page_id_a"), F.greatest("train_key", "eval_key").alias("page_id_b"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps counted per evaluation split and dataset, from the sizes of the groups and not from pairs.

    A page has at most two names, so the pairs that share one are those of the
    exact groups and those of the near groups less those that share both.
    """
    pages = written(group_tokens(spark, sf_dir), "pages")
    kind = lambda t, k: F.try_element_at(F.filter(t, lambda x: F.startswith(x, F.lit(k))), F.lit(1))
    e, n = kind(F.col("tokens"), "exact|"), kind(F.col("tokens"), "near|")
    names = F.array(F.struct(F.lit(1).alias("sign"), e.alias("name")), F.struct(F.lit(1).alias("sign"), n.alias("name")), F.struct(F.lit(-1).alias("sign"), F.concat(e, F.lit("|"), n).alias("name")))
    named = pages.select("page_id", "dataset", "split", F.explode(names).alias("g")).select("page_id", "dataset", "split", "g.*").where("name IS NOT NULL")
    sizes = written(named.groupBy("dataset", "name", "sign", "split").agg(F.count(F.lit(1)).alias("n")), "sizes")
    train, held = sizes.where(F.col("split") == TRAIN).withColumnRenamed("n", "t").drop("split"), sizes.where(F.col("split") != TRAIN)
    both = written(held.join(train, ["dataset", "name", "sign"]), "both")
    pairs = both.groupBy(F.col("split").alias("eval_split"), "dataset").agg(F.sum(F.col("n") * F.col("t") * F.col("sign")).alias("pairs"))
    # pages in a group that has the other side, too
    hit = written(named.where("sign > 0").withColumn("_k", F.concat_ws("|", "dataset", "name")), "named")
    crossed = lambda by: written(both.where("sign > 0").select(F.concat_ws("|", "dataset", "name").alias("_g"), *by).distinct(), "crossed")
    evals = lookup_join(hit.where(F.col("split") != TRAIN), "_k", crossed([]), "_g", "inner").groupBy(F.col("split").alias("eval_split"), "dataset").agg(F.count_distinct("page_id").alias("eval_pages"))
    # a group crosses into at most as many splits as there are
    splits = crossed(["split"]).groupBy("_g").agg(F.collect_set("split").alias("with"))
    trains = lookup_join(hit.where(F.col("split") == TRAIN), "_k", splits, "_g", "inner").select("page_id", "dataset", F.explode("with").alias("eval_split"))
    trains = trains.groupBy("eval_split", "dataset").agg(F.count_distinct("page_id").alias("train_pages"))
    return pairs.join(evals, ["eval_split", "dataset"]).join(trains, ["eval_split", "dataset"])


def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token sequences; those whose id is divisible by 50 are held out."""
    held = F.when(F.col("doc_id") % 50 == 0, "test").otherwise(TRAIN)
    return table(spark, sf_dir, "documents").select("doc_id", "source", held.alias("split"), words(F.col("text")).alias("tokens"))


def p5_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out texts and the train texts that hold four fifths or more of them, by classes of copies, with the sizes of the classes.

    A held-out text that no train text holds has one row without a train class.
    """
    pairs, members = cross_split_classes(text_records(spark, sf_dir), "doc_id", "tokens", "split", "source")
    sizes = written(members.groupBy("class").agg(F.count_if(F.col("split") == TRAIN).alias("train_docs"), F.count_if(F.col("split") != TRAIN).alias("eval_docs")), "sizes")
    own = sizes.where("eval_docs > 0").select(F.col("class").alias("eval_class"), "eval_docs")
    named = own.join(pairs, "eval_class", "left").join(sizes.select(F.col("class").alias("train_class"), "train_docs"), "train_class", "left")
    return named.select("eval_class", "train_class", "eval_docs", F.coalesce("train_docs", F.lit(0)).alias("train_docs"), F.coalesce("covered", F.lit(0)).alias("covered"), F.round(F.coalesce("coverage", F.lit(0.0)), 9).alias("coverage"))


def p5_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per held-out document and source that has it: the share that the best train text covers, and how many train documents do.

    A document that no train text holds has one row without a source.
    """
    pairs, members = cross_split_classes(text_records(spark, sf_dir), "doc_id", "tokens", "split", "source")
    members = written(members, "members")
    trains = members.where(F.col("split") == TRAIN).groupBy(F.col("class").alias("train_class"), "source").agg(F.count(F.lit(1)).alias("n"))
    best = pairs.join(trains, "train_class").groupBy("eval_class", F.col("source").alias("train_source")).agg(F.max("coverage").alias("coverage"), F.sum("n").alias("train_docs"))
    own = members.where(F.col("split") != TRAIN).select(F.col("key").alias("doc_id"), F.col("class").alias("eval_class"))
    return own.join(best, "eval_class", "left").select("doc_id", "train_source", F.round(F.coalesce("coverage", F.lit(0.0)), 9).alias("coverage"), F.coalesce("train_docs", F.lit(0)).alias("train_docs"))


_SQL = f"""WITH cur AS {sqlnames.current('validation', 'page_id')},
    p AS (SELECT page_id, {sqlnames.plain('dataset')} AS dataset, {sqlnames.split('project_split')} AS split,
          {sqlnames.numbered('exact_duplicate_group')} AS e, {sqlnames.numbered('near_duplicate_group')} AS n FROM cur),
    pair AS (SELECT a.page_id AS t, b.page_id AS v, b.split AS eval_split, b.dataset FROM p a JOIN p b ON a.dataset = b.dataset AND a.split = 'train' AND b.split <> 'train'
             AND (a.e = b.e OR a.n = b.n))"""
QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_texts": p5_texts, "p5_sources": p5_sources}
ORACLES = {
    "p5_found": _SQL + " SELECT least(t, v) AS page_id_a, greatest(t, v) AS page_id_b FROM pair",
    "p5_report": _SQL + " SELECT eval_split, dataset, count(*) AS pairs, count(DISTINCT v) AS eval_pages, count(DISTINCT t) AS train_pages FROM pair GROUP BY ALL",
}
