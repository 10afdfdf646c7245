"""Evaluation texts leaking into training text: SimHash windows and exact verification."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from folioflow.sources.tables import table

#: Characters per shingle, and shingles per window.  A window has the size of
#: the smallest stretch that has to survive untouched, not of the whole item:
#: a case may hold half an item, and half an item is far outside any small
#: Hamming radius of the whole.
SHINGLE = 5
WINDOW = 16
#: Fingerprints within this Hamming distance are found, without exception:
#: of RADIUS + 1 blocks at least one is equal (pigeonhole).
RADIUS = 3
BLOCKS = RADIUS + 1
#: Every so manieth window of an item is looked up; texts are looked up at every character.
STRIDE = 4
#: Share of an item's windows that a document must hit to become a candidate.
#: ``exact=True`` looks up every window and verifies every document with a hit.
CANDIDATE = 0.06
#: The held-out items are taken in blocks of so many rows: what is sent to the
#: workers is bounded, however many items there are.
BLOCK_ITEMS = 20_000
#: Share of the item that the aligned stretches have to cover.
COVERED = 0.5
#: Characters between two aligned stretches that still count as read through.
GAP = 24
#: A stretch follows another if at most so many characters of the item are
#: skipped and so many of the text (a foreign line among them) lie between.
SKIPPED, REACH = 90, 220
#: No stretch is longer than this many characters (items are shorter by far).
LONGEST = 4_000
ROWS = 256

# Characters that recognition confuses, folded to one of them.
CONFUSED = {"0": "o", "1": "i", "l": "i", "|": "i", "!": "i", "5": "s", "6": "b", "8": "b", "9": "g", "ı": "i", "ſ": "s", "ß": "s"}
ESCAPES = re.compile(r"&(?:#\d{1,6}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8});|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\[nrt\"'/\\]|=\r?\n|%[0-9A-F]{2}")


def _unescape(match: re.Match) -> str:
    s = match.group()
    if s[0] == "&":
        return html.unescape(s)
    if s[0] == "%":
        return chr(int(s[1:], 16)) if int(s[1:], 16) < 128 else s
    if s[:2] in ("\\u", "\\x"):
        return chr(int(s[2:], 16))
    return " "


_table: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point -> folded code point; 0 where it is dropped.

    Compatibility forms, case, accents and confused characters are folded;
    only letters, digits and the vowel and tone marks of scripts that need
    them are kept.  A form of several characters is folded to its first.
    """
    global _table
    if _table is None:
        out = np.zeros(0x110000, np.uint32)
        for cp in [*range(0x20, 0x3400), *range(0xA640, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x10000, 0x11000)]:
            c = chr(cp)
            for d in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", c).casefold()):
                cat = unicodedata.category(d)
                if cat[0] in "LN" or (cat[0] == "M" and not 0x300 <= ord(d) < 0x370):
                    out[cp] = ord(CONFUSED.get(d, d))
                    break
            if c in CONFUSED:
                out[cp] = ord(CONFUSED[c])
        out[0x3400:0x9FFF] = np.arange(0x3400, 0x9FFF)
        out[0xAC00:0xD7A4] = np.arange(0xAC00, 0xD7A4)
        _table = out
    return _table


def fold(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The folded characters of all texts in a row, and where each text begins (one more than texts)."""
    plain = [ESCAPES.sub(_unescape, t) if t and ("\\" in t or "&" in t or "%" in t or "=" in t) else t or "" for t in texts]
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = fold_table()[codes]
    kept = folded != 0
    ends = np.cumsum([0, *map(len, plain)])
    before = np.concatenate([[0], np.cumsum(kept)])
    return folded[kept], before[ends]


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), so that every bit of the hash is used."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(codes: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hash of the n characters from every position on (len - n + 1 of them)."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + codes[i : len(codes) - n + 1 + i]
    return _mix(h)


def simhashes(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """SimHash of every window of consecutive shingles, by doubling sums of bits."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64)
    out = np.empty(len(hashes) - window + 1, np.uint64)
    step = 1 << 16
    for start in range(0, len(out), step):
        part = hashes[start : start + step + window - 1]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        width = 1
        while width < window:
            bits = bits[:-width] + bits[width:]
            width *= 2
        out[start : start + step] = np.packbits(bits > window // 2, axis=1).view(np.uint64)[:, 0]
    return out


def blocks(fingerprints: np.ndarray) -> np.ndarray:
    """The BLOCKS equal bit blocks of each fingerprint, one row per block."""
    width = 64 // BLOCKS
    return np.stack([((fingerprints >> np.uint64(i * width)) & np.uint64((1 << width) - 1)).astype(np.int64) for i in range(BLOCKS)])


@dataclass
class Items:
    """The evaluation items: a fixed, small table, held by every worker; ``owners`` has the rows of each distinct text."""

    ids: list[int]
    owners: list[list[int]]
    codes: list[np.ndarray]
    weights: list[np.ndarray]
    owner: np.ndarray
    offset: np.ndarray
    prints: np.ndarray
    starts: list[np.ndarray]
    order: list[np.ndarray]
    needed: np.ndarray


def strip_instructions(texts: list[str], shared: int = 3) -> list[str]:
    """Texts without an opening sentence that at least ``shared`` of them have in common."""
    opening = [re.match(r"\s*[^.!?\n]{8,200}[.!?\n]\s*", t or "") for t in texts]
    counts = Counter(m.group().strip().casefold() for m in opening if m)
    return [t[m.end() :] if m and counts[m.group().strip().casefold()] >= shared and len(t) > m.end() else t or "" for t, m in zip(texts, opening)]


def prepare_items(rows: list[tuple[int, str | None]], exact: bool = False) -> Items:
    """The items as every worker needs them; ``exact`` keeps every window and asks for one hit."""
    rows = [(i, t) for i, t in rows if i is not None]
    given: dict[bytes, list[int]] = {}
    for n, (_, t) in enumerate(rows):  # equal items are one, so that they don't pass for common phrases
        given.setdefault(fold([t])[0].tobytes(), []).append(n)
    classes: dict[bytes, list[int]] = {}
    for t, own in zip(strip_instructions([rows[own[0]][1] or "" for own in given.values()]), given.values()):
        classes.setdefault(fold([t])[0].tobytes(), []).extend(own)
    codes = [np.frombuffer(c, np.uint32) for c in classes]
    hashes = [shingle_hashes(c) for c in codes]
    owner, offset, prints = [], [], []
    for n, h in enumerate(hashes):
        s = simhashes(h)
        owner.append(np.full(len(s), n))
        offset.append(np.arange(len(s)))
        prints.append(s)
    own, off, pri = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, offset, prints))
    key = np.unique(np.stack([pri.view(np.int64), own.astype(np.int64)]), axis=1) if len(pri) else np.zeros((2, 0), np.int64)
    values, counts = np.unique(key[0], return_counts=True)
    spread = counts[np.searchsorted(values, pri.view(np.int64))] if len(pri) else np.zeros(0)
    rare = spread <= 2  # windows of phrases that several items use tell nothing
    # unless the rest is so little that a case needn't hold enough of it
    least = [(1 - COVERED + CANDIDATE) * max(0, len(h) - WINDOW + 1) for h in hashes]
    few = np.bincount(own[rare].astype(np.int64), minlength=len(hashes)) < least
    rare |= few[own.astype(np.int64)]
    rare = np.ones(len(off), bool) if exact else rare & (off % STRIDE == 0)
    own, off, pri = own[rare], off[rare], pri[rare]
    df = Counter()
    for h in hashes:
        df.update(set(h.tolist()))
    weights = [np.array([1.0 / df[x] for x in h.tolist()]) for h in hashes]
    starts, order = [], []
    for b in blocks(pri) if len(pri) else []:
        by = np.argsort(b, kind="stable")
        order.append(by)
        starts.append(np.searchsorted(b[by], np.arange((1 << (64 // BLOCKS)) + 1)))
    sizes = np.array([max(1, (own == n).sum()) for n in range(len(codes))])
    return Items([i for i, _ in rows], list(classes.values()), codes, weights, own, off, pri, starts, order, np.ones(len(codes)) if exact else np.maximum(2, np.ceil(sizes * CANDIDATE)))


def near(items: Items, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window of the text, window of the items) for all pairs within RADIUS."""
    found_t, found_i = [], []
    for block, starts, order in zip(blocks(prints), items.starts, items.order):
        n = starts[block + 1] - starts[block]
        at = np.flatnonzero(n)
        if not len(at):
            continue
        n = n[at]
        t = np.repeat(at, n)
        inner = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
        i = order[np.repeat(starts[block[at]], n) + inner]
        close = np.bitwise_count(prints[t] ^ items.prints[i]) <= RADIUS
        found_t.append(t[close])
        found_i.append(i[close])
    if not found_t:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(found_t) * np.int64(len(items.prints)) + np.concatenate(found_i))
    return both // len(items.prints), both % len(items.prints)


def coverage(item: np.ndarray, weight: np.ndarray, text: np.ndarray) -> float:
    """Share of the item that the text holds in running order, 0..1.

    Equal shingles of item and text are seeds; seeds of one diagonal (give or
    take a few characters lost or added) make stretches.  The stretches are
    chained in running order by the best sum of their lengths less a penalty for
    what is skipped; characters between chained neighbours count as covered
    where the gap is short on both sides, as a misread or replaced word leaves it.
    """
    hi, ht = shingle_hashes(item), shingle_hashes(text)
    if not len(hi) or not len(ht):
        return 0.0
    by = np.argsort(hi, kind="stable")
    lo, up = np.searchsorted(hi[by], ht, "left"), np.searchsorted(hi[by], ht, "right")
    n = up - lo
    t = np.repeat(np.arange(len(ht)), n)
    i = by[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    if not len(t):
        return 0.0
    diag = t - i
    by = np.lexsort((t, diag))
    t, i, diag = t[by], i[by], diag[by]
    cut = np.flatnonzero((np.diff(diag) != 0) | (np.diff(t) > 1)) + 1
    a = np.concatenate([[0], cut])
    b = np.concatenate([cut, [len(t)]]) - 1
    si, st, ln = i[a], t[a], i[b] - i[a] + SHINGLE
    w = np.concatenate([[0], np.cumsum(weight)])
    worth = w[si + ln - SHINGLE + 1] - w[si]
    keep = (ln >= 2 * SHINGLE) | (worth >= 0.8 * (ln - SHINGLE + 1))  # short repeats of common phrases are no seeds
    si, st, ln = si[keep], st[keep], ln[keep]
    by = np.lexsort((si, st))
    si, st, ln = si[by].tolist(), st[by].tolist(), ln[by].tolist()
    best: list[tuple[float, int]] = []
    top = (0.0, 0)
    first = 0
    for k in range(len(si)):
        i0, t0, n0 = si[k], st[k], ln[k]
        while st[first] + ln[first] + REACH < t0 - LONGEST:
            first += 1
        here = (float(n0), n0)
        for j in range(first, k):
            gi, gt = i0 - si[j] - ln[j], t0 - st[j] - ln[j]
            if i0 <= si[j] or t0 <= st[j] or i0 + n0 <= si[j] + ln[j] or gi > SKIPPED or gt > REACH or gi < -n0 or gt < -n0:
                continue
            lost = -min(gi, gt, 0)  # overlapping characters count once
            through = gi if 0 < gi <= GAP and gt <= 2 * GAP else 0
            score = best[j][0] + n0 - lost - 0.5 * (max(gi, 0) - through) - 0.1 * max(0, gt - max(gi, 0))
            if score > here[0]:
                here = (score, best[j][1] + n0 - lost + through)
        best.append(here)
        top = max(top, here)
    return min(1.0, top[1] / len(item))


def find_leaks(documents: DataFrame, key: str, text: str, items: list[tuple[int, str | None]], least: float = COVERED, exact: bool = False) -> DataFrame:
    """(key, item_id, covered): documents that hold at least ``least`` of an item.

    ``items`` is the held-out table, or a block of it, as (id, text), at most
    BLOCK_ITEMS rows; it is prepared once and sent to every worker.  Each batch
    of documents is folded, fingerprinted window by window, looked up in the
    items' Hamming blocks and verified, whole texts and without a shuffle.
    ``exact`` looks up every window of every item (also those of phrases that
    many items use) and verifies every document that hits one, at four times
    the lookups.  Null, empty and blank texts, items shorter than a window and
    null keys leak nothing; repeated documents and items each have their rows.
    """
    if len(items) > BLOCK_ITEMS:
        raise ValueError(f"at most {BLOCK_ITEMS} items at a time; leaks_of takes a table of any size")
    rows = documents.where(documents[key].isNotNull()).select(key, documents[text].alias("_text"))
    shared = documents.sparkSession.sparkContext.broadcast(prepare_items(items, exact))
    schema = documents.select(key).schema.add("item_id", T.LongType()).add("covered", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = shared.value
        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                found = list(leaks_in(prepared, b.column(1).to_pylist(), least))
                ids = b.column(0).take(pa.array([d for d, _, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([prepared.ids[i] for _, i, _ in found], pa.int64()), pa.array([c for _, _, c in found], pa.float64())], names=[key, "item_id", "covered"])

    return rows.mapInArrow(run, schema)


def leaks_of(documents: DataFrame, key: str, text: str, held_out: DataFrame, item: str, passage: str, least: float = COVERED, exact: bool = False, block: int = BLOCK_ITEMS) -> DataFrame:
    """:func:`find_leaks` for a held-out table of any size: blocks of its rows against all documents.

    The table is counted first.  Up to ``block`` rows are one pass over the
    documents; beyond that every block of the items' hash is a pass of its
    own, and whether a phrase is common is told within a block.  Rows with a
    null id are left out.
    """
    rows = held_out.where(F.col(item).isNotNull()).select(F.col(item).cast("bigint").alias("i"), F.col(passage).alias("t"))
    n = max(1, -(-rows.count() // block))
    if n > 1:
        n *= 2  # blocks of a hash are uneven
    part = F.pmod(F.xxhash64("i"), F.lit(n))
    found = [find_leaks(documents, key, text, [(r["i"], r["t"]) for r in rows.where(part == k).toLocalIterator()], least, exact) for k in range(n)]
    return reduce(DataFrame.unionByName, found)


def leaks_in(items: Items, texts: list[str | None], least: float) -> Iterator[tuple[int, int, float]]:
    codes, ends = fold(texts)
    if not len(items.prints) or not len(codes):
        return
    prints = simhashes(shingle_hashes(codes))
    if not len(prints):
        return
    span = SHINGLE + WINDOW - 2
    doc = np.searchsorted(ends, np.arange(len(prints)), "right") - 1
    inside = np.arange(len(prints)) + span < ends[doc + 1]
    at = np.flatnonzero(inside)
    t, i = near(items, prints[at])
    if not len(t):
        return
    hit = np.unique(np.stack([doc[at[t]], items.owner[i], items.offset[i]]), axis=1)
    pair, n = np.unique(hit[:2], axis=1, return_counts=True)
    for d, item in pair[:, n >= items.needed[pair[1]]].T.tolist():
        c = coverage(items.codes[item], items.weights[item], codes[ends[d] : ends[d + 1]])
        if c >= least:
            for n in items.owners[item]:
                yield d, n, c


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks_of(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, sf_dir).select("doc_id", "item_id")


QUERIES = {"p8_found": p8_found}
