"""Subject areas of documents: anchored non-negative factorisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from folioflow.llm.features import hashed_words
from folioflow.sources.tables import table

#: The factorisation starts from at most so many labelled documents (chosen by
#: the hash of their id); the alternation over the corpus covers every document.
LABELLED = 6_000
#: Alternations over the whole corpus after the one over the labelled documents.
ROUNDS = 1
BACKGROUND = 1
UPDATES = 25
#: A term belongs to the model if this share of its weight lies in one subject.
SHARE = 0.65
#: The same share for terms found by the corpus, and the weight that counts
#: against them beside their own.
CORPUS_SHARE, AGAINST = 0.8, 2.0
#: Terms of the model, at most; those with the least weight are left out.
TERMS = 200_000
#: Lines, sentences or fields on a subject that make a whole block: so many
#: anywhere in the document, or two that are at most NEAR units apart.
BLOCK = 3
NEAR = 4
#: Units to both sides of a unit that the corpus factorisation takes as its row.
REACH = 2
ROWS = 512


@dataclass
class Factors:
    """The term factor: sorted term hashes and, per term, its weight in every component."""

    terms: np.ndarray
    weight: np.ndarray  # terms x subjects, columns sum to one
    subjects: np.ndarray


def _ratio_step(rows: np.ndarray, cols: np.ndarray, v: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Share of every cell's value that each component explains (cells x components)."""
    part = w[rows] * h[cols]
    part *= (v / np.maximum(part.sum(1), 1e-12))[:, None]
    return part


def _sums(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Row sums of ``values`` by ``index``."""
    order = np.argsort(index, kind="stable")
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(index):
        cuts = np.flatnonzero(np.diff(index[order], prepend=-1))
        out[index[order][cuts]] = np.add.reduceat(values[order], cuts, axis=0)
    return out


def anchored_factors(texts: list[str | None], labels: list[set[int]], subjects: list[int]) -> Factors:
    """Factorise the labelled documents by alternating multiplicative updates.

    One component per subject and BACKGROUND for what all documents share; a document's
    mixture is anchored: it may hold its own subjects and the background, and
    multiplicative updates keep the zeros of all others.  The term factor
    starts from the sums of the documents; every document weighs the same.
    The updates minimise the Kullback-Leibler divergence.
    """
    text, _, feature = hashed_words(texts)
    k, n = len(subjects), len(texts)
    if not len(feature):
        return Factors(np.zeros(0, np.uint64), np.zeros((0, k)), np.array(subjects))
    terms, cols = np.unique(feature, return_inverse=True)
    cells = np.unique(text.astype(np.int64) * len(terms) + cols)
    rows, cols = cells // len(terms), cells % len(terms)
    v = (100.0 / np.bincount(rows, minlength=n)[rows]).astype(np.float32)
    at = {s: i for i, s in enumerate(subjects)}
    w = np.zeros((n, k + BACKGROUND), np.float32)
    for i, own in enumerate(labels):
        for s in own:
            if s in at:
                w[i, at[s]] = 1.0
    w[:, k:] = 0.5 + 0.1 * np.random.default_rng(7).random((n, BACKGROUND))
    h = _sums(cols, w[rows], len(terms))
    h /= np.maximum(h.sum(0), 1e-12)
    for _ in range(UPDATES):
        part = _ratio_step(rows, cols, v, w, h)
        w = _sums(rows, part, n)
        h = _sums(cols, part, len(terms))
        mass = h
        h = h / np.maximum(h.sum(0), 1e-12)
    return _chosen(terms, mass, np.array(subjects))


def _chosen(terms: np.ndarray, mass: np.ndarray, subjects: np.ndarray) -> Factors:
    """The terms that tell subjects apart; one more unit of weight is nobody's."""
    k = len(subjects)
    share = mass[:, :k] / (mass.sum(1, keepdims=True) + 1.0)
    good = np.flatnonzero(share.max(1) >= SHARE) if len(terms) else np.zeros(0, np.int64)
    if len(good) > TERMS:
        good = np.sort(good[np.argsort(-mass[good, :k].sum(1), kind="stable")[:TERMS]])
    weight = mass[good, :k]
    return Factors(terms[good], weight / np.maximum(weight.sum(0), 1e-12), subjects)


def mixtures(f: Factors, texts: list[str | None], updates: int = 6) -> tuple[np.ndarray, np.ndarray, tuple, tuple]:
    """(mixture, blocks, words, units): documents x subjects each, the hashed words, and the units with their subject.

    The mixture is folded in: multiplicative updates with the term factor kept.
    ``blocks`` counts, where they make a whole block, the units whose terms, given the mixture of the whole
    document, speak for the subject; so a term of two subjects follows the
    subject that the rest of the document is about.
    """
    n, k = len(texts), len(f.subjects)
    words = hashed_words(texts)
    text, unit, feature = words
    none, nowhere = np.zeros((n, k)), (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(f.terms) or not len(feature):
        return none, none, words, nowhere
    pos = np.minimum(np.searchsorted(f.terms, feature), len(f.terms) - 1)
    hit = f.terms[pos] == feature
    cells = np.unique(np.stack([text[hit], unit[hit], pos[hit]]), axis=1)
    rows, units, cols = cells
    if not len(rows):
        return none, none, words, nowhere
    h = f.weight[cols]
    w = np.ones((n, k))
    for _ in range(updates):
        part = w[rows] * h
        part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
        w = _sums(rows, part, n) + 1e-6
    # a unit speaks for one subject: the one that explains most of its terms
    start = np.flatnonzero(np.diff(units, prepend=-1))
    said = np.add.reduceat(part, start, axis=0)
    best = said.argmax(1)
    sure = said[np.arange(len(best)), best] > 0.5 * said.sum(1)
    count = np.zeros((n, k))
    doc, at, what = rows[start][sure], units[start][sure], best[sure]
    np.add.at(count, (doc, what), 1)
    by = np.lexsort((at, what, doc))
    close = (doc[by][1:] == doc[by][:-1]) & (what[by][1:] == what[by][:-1]) & (at[by][1:] - at[by][:-1] <= NEAR)
    block = count >= BLOCK
    block[doc[by][1:][close], what[by][1:][close]] = True
    return w, np.where(block, np.maximum(count, 1), 0), words, (at, what)


def windows(rows: np.ndarray, unit: np.ndarray, spoken: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(units, mixture): the subjects of the units around each unit that has words.

    A window reaches REACH units to both sides within its text; its mixture is
    the share of every subject among the units that speak for one.
    """
    units, first = np.unique(unit, return_index=True)
    text = rows[first]
    own = np.zeros((len(units) + 1, k), np.float32)
    np.add.at(own, (np.searchsorted(units, spoken[0]) + 1, spoken[1]), 1)
    upto = np.cumsum(own, axis=0)
    at = np.arange(len(units))
    lo = np.maximum(at - REACH, np.searchsorted(text, text, "left"))
    hi = np.minimum(at + REACH + 1, np.searchsorted(text, text, "right"))
    said = upto[hi] - upto[lo]
    total = said.sum(1, keepdims=True)
    return units, np.where(total > 0, said / np.maximum(total, 1), 0)


def corpus_update(documents: DataFrame, text: str, f: Factors) -> Factors:
    """One alternation over the whole corpus: mixtures, then the term factor.

    The rows are windows of a few units, because a document's blocks may be
    about different subjects.  A window's mixture comes from the present
    factor; the new weight of a term in a subject is the sum of the mixtures
    of the windows that hold it, whether or not it was in the model before, so
    terms spread to every language and spelling they occur with.  Tasks sum
    their windows first; the sums per term are added by a shuffle and only
    terms that tell subjects apart (at most TERMS) come to the driver.
    """
    shared = documents.sparkSession.sparkContext.broadcast(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = shared.value
        held: list[tuple] = []
        size = 0
        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                _, _, (rows, unit, feature), spoken = mixtures(factors, b.column(0).to_pylist())
                if not len(spoken[0]):
                    continue
                units, w = windows(rows, unit, spoken, len(factors.subjects))
                rows = np.searchsorted(units, unit)
                told = w[rows].any(1)
                rows, feature = rows[told], feature[told]
                by = np.lexsort((rows, feature))
                feature, rows = feature[by], rows[by]
                once = np.ones(len(feature), bool)
                once[1:] = (feature[1:] != feature[:-1]) | (rows[1:] != rows[:-1])
                feature, rows = feature[once], rows[once]
                cut = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]]))
                held.append((feature[cut], np.add.reduceat(w[rows], cut, axis=0).astype(np.float32)))
                size += len(cut)
                if size > 1_000_000:
                    held, size = [_added(held)], 0
        if held:
            terms, mass = _added(held)
            at, component = np.nonzero(mass >= 0.05)
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms.view(np.int64)[at]), pa.array(component.astype(np.int8)), pa.array(mass[at, component])], names=["term", "component", "mass"]
            )

    part = documents.select(text).mapInArrow(run, "term bigint, component tinyint, mass float")
    k = len(f.subjects)
    columns = [F.sum(F.when(F.col("component") == i, F.col("mass")).otherwise(0.0)).cast("float").alias(f"c{i}") for i in range(k)]
    subjects = [F.col(f"c{i}") for i in range(k)]
    summed = part.groupBy("term").agg(*columns)
    total = sum(subjects[1:], subjects[0])
    top = F.greatest(*subjects) if k > 1 else subjects[0]
    told = summed.where(top >= CORPUS_SHARE * (total + AGAINST)).orderBy(F.desc(total), "term").limit(TERMS)
    got = told.toArrow()
    terms = got.column(0).to_numpy().view(np.uint64)
    mass = np.stack([got.column(i + 1).to_numpy() for i in range(k)], axis=1).astype(float) if len(terms) else np.zeros((0, k))
    by = np.argsort(terms)
    return _chosen(terms[by], mass[by], f.subjects)


def _added(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    terms, mass = np.concatenate([t for t, _ in held]), np.concatenate([m for _, m in held])
    by = np.argsort(terms, kind="stable")
    terms, mass = terms[by], mass[by]
    cut = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
    return terms[cut], np.add.reduceat(mass, cut, axis=0)


def labelled_sample(documents: DataFrame, labels: DataFrame, key: str, text: str, subject: str, most: int = LABELLED) -> list[tuple[str | None, set[int]]]:
    """At most ``most`` labelled documents with their subjects; repeated labels count once."""
    own = labels.where(F.col(key).isNotNull() & F.col(subject).isNotNull()).groupBy(key).agg(F.collect_set(subject).alias("subjects"))
    own = own.orderBy(F.xxhash64(key), key).limit(most)
    rows = documents.join(F.broadcast(own), key).select(text, "subjects").collect()  # bounded by ``most``
    return [(r[0], set(r[1])) for r in rows]


def fit(documents: DataFrame, labels: DataFrame, subjects: list[int], key: str, text: str, subject: str, rounds: int = ROUNDS) -> Factors:
    sample = labelled_sample(documents, labels, key, text, subject)
    f = anchored_factors([t for t, _ in sample], [s for _, s in sample], subjects)
    for _ in range(rounds):
        f = corpus_update(documents, text, f)
    return f


def subject_areas(documents: DataFrame, key: str, text: str, f: Factors) -> DataFrame:
    """(key, subject_id, units, share): the subjects that a document gives a whole block.

    A null, empty or wordless text and a document about none of the subjects
    have no row; repeated documents each have theirs; null keys are left out.
    """
    shared = documents.sparkSession.sparkContext.broadcast(f)
    rows = documents.where(F.col(key).isNotNull()).select(F.col(key), F.col(text).alias("_text"))
    schema = documents.select(key).schema.add("subject_id", T.LongType()).add("units", T.IntegerType()).add("share", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = shared.value
        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                w, count, _, _ = mixtures(factors, b.column(1).to_pylist())
                d, s = np.nonzero(count)
                share = w / np.maximum(w.sum(1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(d)), pa.array(factors.subjects[s].astype(np.int64)), pa.array(count[d, s].astype(np.int32)), pa.array(share[d, s])],
                    names=[key, "subject_id", "units", "share"],
                )

    return rows.mapInArrow(run, schema)


def document_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    subjects = sorted(r[0] for r in table(spark, sf_dir, "subject_areas").where("subject_id IS NOT NULL").select("subject_id").distinct().collect())
    f = fit(documents, table(spark, sf_dir, "subject_labels"), subjects, "doc_id", "text", "subject_id")
    return subject_areas(documents, "doc_id", "text", f)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_subjects(spark, sf_dir).select("doc_id", "subject_id")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and weight per subject, so that the corpus can be measured and adjusted."""
    areas = table(spark, sf_dir, "subject_areas").select("subject_id", "name")
    found = document_subjects(spark, sf_dir).groupBy("subject_id").agg(F.count(F.lit(1)).alias("documents"), F.round(F.sum("share"), 6).alias("weight"))
    return areas.join(found, "subject_id", "left").select("subject_id", "name", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


QUERIES = {"p9_found": p9_found, "p9_composition": p9_composition}
