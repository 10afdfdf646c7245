"""Encoding of a whole corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from folioflow.sources.tables import table

#: Where the vocabulary files lie; they are read there and never copied.
TOKENIZERS = os.environ.get("FOLIOFLOW_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of more bytes are merged with a heap, so that a word of any length takes n log n steps.
SHORT = 128
#: Distinct words remembered by a worker; beyond it the memory starts anew.
REMEMBERED = 500_000
ROWS = 2_000
NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, which is also the order of the merges."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word: a contiguous array of part boundaries and adjacent ranks.

    ``at[i]`` is where part i begins and ``rank[i]`` the rank of part i joined
    with part i + 1.  The scan finds the smallest rank (the leftmost of equal
    ones), deletes the boundary in between and refreshes the ranks at both
    sides, until no adjacent parts join to a token.
    """
    known = ranks.get(word)
    if known is not None:
        return [known]
    at = list(range(len(word) + 1))
    get = ranks.get
    rank = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while rank:
        least = min(rank)
        if least == NONE:
            break
        i = rank.index(least)
        del at[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(word[at[i] : at[i + 2]], NONE)
        if i:
            rank[i - 1] = get(word[at[i - 1] : at[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(at, at[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word: linked parts and a heap of adjacent ranks."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    after = list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != stop:
            continue  # one of the two parts has changed since
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        h = before[i]
        if h >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Words(dict):
    """Ids by word; a word not seen before is merged and remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= REMEMBERED:
            self.clear()
        raw = word.encode()
        ids = (merge_short if len(raw) <= SHORT else merge_long)(raw, self.ranks)
        if len(raw) <= SHORT:
            self[word] = ids
        return ids


class Encoder:
    """Text -> ids, without special tokens: their strings are ordinary text."""

    def __init__(self, path: str):
        import regex

        self.words = Words(load_ranks(path))
        self.split = regex.compile(PATTERN).findall

    def __call__(self, text: str | None) -> Iterator[int]:
        return chain.from_iterable(map(self.words.__getitem__, self.split(text))) if text else iter(())


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(documents: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids): the token ids of every row's text.

    A null or an empty text gives an empty list, a blank text the ids of its
    white space; every row comes out, also with a null or repeated key.  Texts
    are encoded whole, batch by batch, without a shuffle; ``path`` names the
    rank file, which has to be readable on every executor.
    """
    rows = documents.select(F.col(key), F.col(text).alias("_text"))
    schema = documents.select(key).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for whole in batches:
            for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                flat: list[int] = []
                ends = [0]
                for t in batch.column(1).to_pylist():
                    flat.extend(encoder(t))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return rows.mapInArrow(run, schema)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


QUERIES = {"p7_ids": p7_ids}
