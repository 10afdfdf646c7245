"""Order-dependent matching within one page: Arrow kernels behind a page key.

Every kernel sees one page at a time (a page holds a bounded number of words);
pages are the grouping key, so any number of pages runs in parallel.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from copy import deepcopy
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from folioflow.functions.geometry import convex_iou

# Words of table headers.
HEADERS = {
    "description": ("description", "item", "product", "details", "açıklama", "ürün", "รายการ", "สินค้า"),
    "quantity": ("qty", "quantity", "adet", "miktar", "จำนวน"),
    "unit_price": ("unit price", "price", "birim fiyat", "fiyat", "ราคาต่อหน่วย", "ราคา"),
    "line_total": ("line total", "amount", "total", "tutar", "toplam", "จำนวนเงิน", "รวม"),
}
BOX = ["x0", "y0", "x1", "y1"]
BAND = 64.0
#: Width and height of the cells in which boxes of two readings meet.
CELL = (128.0, 32.0)
ROWS = 512


def per_page(df: DataFrame, page: str, kernel, schema) -> DataFrame:
    """``kernel`` maps a page's columns (name -> list) to result columns; Arrow in, Arrow out.

    Pages are hashed over the tasks and sorted, and each task walks through its
    pages: an exchange between processes holds many small pages, and no more
    than one page is kept back.
    """
    out = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(out)

    def done(parts: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(parts)
        result = kernel(whole.to_pydict())
        return pa.table([pa.array(result[f.name], f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            t, ready = pa.Table.from_batches([b]), []
            if not b.num_rows:
                continue
            if held and not _same(held[-1].column(page)[-1], t.column(page)[0]):
                ready.append(done(held))
                held = []
            cuts = [0, *_changes(b.column(page)), b.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:]):
                held.append(t.slice(start, end - start))
                if end < b.num_rows:
                    ready.append(done(held))
                    held = []
            if ready:
                yield from pa.concat_tables(ready).combine_chunks().to_batches()
        if held:
            yield from done(held).to_batches()

    return spread(df, page).sortWithinPartitions(page).mapInArrow(run, out)


def _same(a: pa.Scalar, b: pa.Scalar) -> bool:
    return a.as_py() == b.as_py()


def _changes(keys: pa.Array) -> list[int]:
    """Places (from 1) whose key differs from the one before; nulls are equal."""
    a, b = keys.slice(1), keys.slice(0, len(keys) - 1)
    torn = pc.or_(pc.xor(pc.is_null(a), pc.is_null(b)), pc.fill_null(pc.not_equal(a, b), False))
    return (np.flatnonzero(torn.to_numpy(zero_copy_only=False)) + 1).tolist()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows hashed by ``keys`` over all shuffle partitions: a kernel's work isn't in proportion to its bytes, so they aren't merged by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _corners(b) -> list[tuple[float, float]]:
    x0, y0, x1, y1 = b
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def _greedy(pairs: list[tuple]) -> list[tuple]:
    """One-to-one pairs (score, left, right, ...) from the best down; ties go to the higher index."""
    left, right, out = set(), set(), []
    for p in sorted(pairs, reverse=True):
        if p[1] not in left and p[2] not in right:
            left.add(p[1])
            right.add(p[2])
            out.append(p)
    return out


def match_boxes(reference: DataFrame, predicted: DataFrame, page: str, least: float = 0.5) -> DataFrame:
    """(page, ref_id, pred_id, iou): one-to-one matches of boxes by overlap, best first.

    Overlapping pairs come from a join on the page and the CELL of pixels in
    which the common part begins; only these pairs reach the page kernel.
    """
    span = lambda lo, hi, size: F.sequence(F.floor(F.col(lo) / size), F.floor(F.greatest(lo, hi) / size))

    def celled(df: DataFrame, side: str, name: str) -> DataFrame:
        own = df.select(page, F.col("id").alias(name), *[F.col(c).alias(f"{side}_{c}") for c in BOX])
        return own.withColumn("_row", F.explode(span(f"{side}_y0", f"{side}_y1", CELL[1]))).withColumn("_col", F.explode(span(f"{side}_x0", f"{side}_x1", CELL[0])))

    r, p = celled(reference, "r", "ref_id"), celled(predicted, "p", "pred_id")
    w = F.least("r_x1", "p_x1") - F.greatest("r_x0", "p_x0")
    h = F.least("r_y1", "p_y1") - F.greatest("r_y0", "p_y0")
    size = lambda a: (F.col(f"{a}_x1") - F.col(f"{a}_x0")) * (F.col(f"{a}_y1") - F.col(f"{a}_y0"))
    first = (F.floor(F.greatest("r_y0", "p_y0") / CELL[1]) == F.col("_row")) & (F.floor(F.greatest("r_x0", "p_x0") / CELL[0]) == F.col("_col"))
    pairs = r.join(p, [page, "_row", "_col"]).where(first & (w > 0) & (h > 0)).select(page, "ref_id", "pred_id", (w * h / (size("r") + size("p") - w * h)).alias("iou")).where(F.col("iou") >= least)
    key = pairs.schema[page].dataType.simpleString()
    types = pairs.schema["ref_id"].dataType.simpleString(), pairs.schema["pred_id"].dataType.simpleString()

    def kernel(c: dict) -> dict:
        best = _greedy(list(zip(c["iou"], c["ref_id"], c["pred_id"])))
        return {page: c[page][:1] * len(best), "ref_id": [b[1] for b in best], "pred_id": [b[2] for b in best], "iou": [b[0] for b in best]}

    return per_page(pairs, page, kernel, f"{page} {key}, ref_id {types[0]}, pred_id {types[1]}, iou double")


def suppress(words: DataFrame, page: str, least: float = 0.5) -> DataFrame:
    """Words kept after suppression: from the surest down, a word that covers a kept one is dropped.

    Two words are one where they overlap by ``least`` and say the same, or
    overlap by 0.8 whatever they say.
    """
    def kernel(c: dict) -> dict:
        rows = [dict(zip(c, r)) for r in zip(*c.values())]
        said = [" ".join((r["text"] or "").casefold().split()) for r in rows]
        size = [max(0.0, r["x1"] - r["x0"]) * max(0.0, r["y1"] - r["y0"]) for r in rows]
        kept: list[int] = []
        bands: dict[int, list[int]] = {}  # kept words by the bands of pixels that they touch
        for i in sorted(range(len(rows)), key=lambda i: (rows[i]["confidence"] or 0.0, size[i], (rows[i]["text"] or "").casefold()), reverse=True):
            box = [rows[i][c] for c in BOX]
            touched = range(int(box[1] // BAND), int(box[3] // BAND) + 1)
            near = (k for n in touched for k in bands.get(n, ()) if min(box[2], rows[k]["x1"]) > max(box[0], rows[k]["x0"]) and min(box[3], rows[k]["y1"]) > max(box[1], rows[k]["y0"]))
            if said[i] and not any((o := convex_iou(_corners(box), _corners([rows[k][c] for c in BOX]))) >= least and (said[i] == said[k] or o >= max(0.8, least)) for k in near):
                kept.append(i)
                for n in touched:
                    bands.setdefault(n, []).append(i)
        return {n: [v[i] for i in sorted(kept)] for n, v in c.items()}

    return per_page(words, page, kernel, words.schema)


class Means:
    """Rows of boxes as running means of their centres, kept in one array."""

    def __init__(self, most: int):
        self.mean = np.empty(most)
        self.size = np.zeros(most, np.int64)
        self.used = 0

    def place(self, centre: float, reach: float) -> int:
        """The oldest row whose mean lies within ``reach`` of ``centre``, or a new one."""
        close = np.abs(self.mean[: self.used] - centre) <= reach
        row = int(close.argmax()) if close.any() else self.used
        if row == self.used:
            self.mean[row], self.used = 0.0, row + 1
        self.size[row] += 1
        self.mean[row] += (centre - self.mean[row]) / self.size[row]
        return row


def row_numbers(boxes: np.ndarray, share: float, order: np.ndarray) -> np.ndarray:
    """The row of every box (0 is the oldest), taken in ``order``; rows reach ``share`` of the median height."""
    reach = max(2.0, share * float(np.median(np.maximum(1.0, boxes[:, 3] - boxes[:, 1]))))
    centres = (boxes[:, 1] + boxes[:, 3]) / 2
    means, rows = Means(len(boxes)), np.empty(len(boxes), np.int64)
    for i in order.tolist():
        rows[i] = means.place(centres[i], reach)
    return rows


def _boxes(c: dict) -> np.ndarray:
    return np.column_stack([np.asarray(c[n], float) for n in BOX])


def reading_order(words: DataFrame, page: str) -> DataFrame:
    """Adds position: rows from the top, words from the left.

    Rows gather words from the top down whose centre lies within 0.6 of the
    median height of the row's mean; rows are ordered by the mean of their
    centres, words of a row by their left edge and then as given.
    """
    def kernel(c: dict) -> dict:
        boxes = _boxes(c)
        rows = row_numbers(boxes, 0.6, np.lexsort((boxes[:, 0], boxes[:, 1])))
        centres = (boxes[:, 1] + boxes[:, 3]) / 2
        mean = np.bincount(rows, centres) / np.bincount(rows)
        rank = np.empty(len(mean), np.int64)
        rank[np.argsort(mean, kind="stable")] = np.arange(len(mean))
        position = np.empty(len(boxes), np.int64)
        position[np.lexsort((boxes[:, 0], rank[rows]))] = np.arange(len(boxes))
        return {**c, "position": position}

    return per_page(words, page, kernel, _with(words, position="integer"))


def _with(df: DataFrame, **columns: str):
    schema = deepcopy(df.schema)
    for name, kind in columns.items():
        schema = schema.add(name, kind)
    return schema


def header_meanings(said: list[str]) -> list[str | None]:
    """What the header words in each text stand for."""
    return [next((name for name, words in HEADERS.items() if any(w in t for w in words)), None) for t in said]


def table_grid(cells: DataFrame, page: str) -> DataFrame:
    """Adds row_index, column_index, row_type and semantic to table cells; pages with one cell are left out.

    The header is the first of the two topmost rows with two header words; it
    gives its columns their meaning, rows below it are items, all else is unknown.
    """
    def kernel(c: dict) -> dict:
        boxes = _boxes(c)
        if len(boxes) < 2:
            return {n: [] for n in (*c, "row_index", "column_index", "row_type", "semantic")}
        rows = row_numbers(boxes, 0.7, np.lexsort((boxes[:, 0], (boxes[:, 1] + boxes[:, 3]) / 2)))
        by = np.lexsort((boxes[:, 0], rows))
        starts = np.searchsorted(rows[by], np.arange(rows.max() + 2))
        columns = np.empty(len(boxes), np.int64)
        columns[by] = np.arange(len(boxes)) - starts[rows[by]]
        header, named = len(starts), {}
        for n in range(min(2, len(starts) - 1)):
            found = header_meanings([(c["text"][i] or "").casefold() for i in by[starts[n] : starts[n + 1]]])
            if sum(m is not None for m in found) >= 2:
                header, named = n, dict(enumerate(found))
                break
        kinds = np.select([np.full(len(rows), header == len(starts)), rows < header, rows == header], ["unknown", "unknown", "header"], "item")
        return {**c, "row_index": rows, "column_index": columns, "row_type": kinds.tolist(), "semantic": [named.get(k) or "unknown" for k in columns.tolist()]}

    return per_page(cells, page, kernel, _with(cells, row_index="integer", column_index="integer", row_type="string", semantic="string"))


#: A word fits a line that it overlaps by this share of the lower of both, or
#: whose bottom is this share of the taller of both away, with at most so many
#: of its heights between them.
LINE_OVERLAP, LINE_SHIFT, LINE_GAP = 0.35, 0.55, 12.0


class OpenLines:
    """The lines of a page so far, one array per edge, so a word meets all at once."""

    def __init__(self, most: int):
        self.box = np.empty((4, most))
        self.height = np.empty(most)
        self.used = 0

    def fit(self, left: float, top: float, bottom: float) -> int:
        """The line that a word fits best (overlap less relative shift; of equals the oldest), or -1."""
        n = self.used
        own, height = bottom - top, self.height[:n]
        low, tall = np.minimum(height, own), np.maximum(height, own)
        shared = np.minimum(self.box[3, :n], bottom) - np.maximum(self.box[1, :n], top)
        overlap = np.maximum(shared, 0.0) / np.where(low > 0, low, np.inf)
        shift = np.abs(self.box[3, :n] - bottom)
        fits = ((overlap >= LINE_OVERLAP) | (shift <= LINE_SHIFT * tall)) & (left - self.box[2, :n] <= LINE_GAP * tall)
        at = np.flatnonzero(fits)
        if len(at) > 1:
            return int(at[(overlap[at] - shift[at] / np.maximum(tall[at], 1.0)).argmax()])
        return int(at[0]) if len(at) else -1

    def take(self, line: int, word: list[float]) -> int:
        """Adds a word to a line, or opens one for it."""
        if line < 0:
            line, self.used = self.used, self.used + 1
            self.box[:, line] = word
        else:
            x0, y0, x1, y1 = self.box[:, line].tolist()
            self.box[:, line] = min(x0, word[0]), min(y0, word[1]), max(x1, word[2]), max(y1, word[3])
        self.height[line] = self.box[3, line] - self.box[1, line]
        return line


def line_groups(words: DataFrame, page: str) -> DataFrame:
    """(page, line_no, text, box): words joined to lines by overlap, baseline and gap, from the top left on."""
    def kernel(c: dict) -> dict:
        boxes, said = _boxes(c), [t or "" for t in c["text"]]
        lines, home = OpenLines(len(boxes)), np.empty(len(boxes), np.int64)
        texts = np.empty(len(said), object)
        texts[:] = said
        order = sorted(range(len(boxes)), key=lambda i: (boxes[i, 1], boxes[i, 0], said[i], boxes[i, 2], boxes[i, 3]))
        given = boxes.tolist()
        for i in order:
            x0, y0, _, y1 = given[i]
            home[i] = lines.take(lines.fit(x0, y0, y1), given[i])
        box = lines.box[:, : lines.used]
        rank = np.empty(lines.used, np.int64)
        rank[by := np.lexsort((box[0], box[1]))] = np.arange(lines.used)
        inner = sorted(range(len(boxes)), key=lambda i: (rank[home[i]], boxes[i, 0], boxes[i, 1], said[i]))
        cuts = np.searchsorted(rank[home[inner]], np.arange(1, lines.used))
        return {page: c[page][:1] * lines.used, "line_no": np.arange(lines.used), "text": [" ".join(part) for part in np.split(texts[inner], cuts)], **{n: box[k][by] for k, n in enumerate(BOX)}}

    return per_page(words, page, kernel, f"{page} {words.schema[page].dataType.simpleString()}, line_no int, text string, x0 double, y0 double, x1 double, y1 double")


@lru_cache(1 << 17)
def plain(text: str | None) -> str:
    """Folded text without anything but word characters and Thai."""
    if text and text.isascii() and text.isalnum():
        return text.lower()
    return re.sub(r"[^\w฀-๿]+", "", unicodedata.normalize("NFKC", text or "").casefold().replace("i̇", "i"))


# Names of the ways in which two texts agree, and the bonus and ceiling of a containment.
EXACT, WITHIN, AROUND, ALIKE = KINDS = "exact", "ocr_contains_annotation", "annotation_contains_ocr", "similarity"
BONUS, CEILING = 0.25, 0.98


def text_scores(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and kind of every pair (a[i], b[i]) of plain texts, as arrays.

    The share of the longer text that the shorter makes up counts for a
    containment of two characters or more; only pairs that neither equal nor
    contain each other are compared block by block.
    """
    na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    within = (na >= 2) & np.fromiter((x in y for x, y in zip(a, b)), bool, len(a))
    around = (nb >= 2) & np.fromiter((y in x for x, y in zip(a, b)), bool, len(a))
    kinds = np.select([a == b, within, around], [EXACT, WITHIN, AROUND], ALIKE)
    share = np.minimum(na, nb) / np.maximum(1, np.maximum(na, nb))
    scores = np.where(kinds == EXACT, 1.0, np.minimum(CEILING, share + BONUS))
    rest = np.flatnonzero(kinds == ALIKE)
    scores[rest] = [SequenceMatcher(None, a[i], b[i]).ratio() for i in rest]
    return scores, kinds


def text_score(source: str, other: str) -> tuple[float, str]:
    """:func:`text_scores` of one pair."""
    s, k = text_scores(np.array([source], object), np.array([other], object))
    return float(s[0]), str(k[0])


def place_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every pair of boxes their overlap, or their nearness relative to their size, whichever is more."""
    return nearness(tuple(a.T[:, :, None]), tuple(b.T[:, None, :]))


def nearness(a: tuple, b: tuple) -> np.ndarray:
    """:func:`place_scores` of boxes given as arrays of their edges (x0, y0, x1, y1)."""
    w = np.maximum(0.0, np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]))
    h = np.maximum(0.0, np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]))
    sa, sb = (np.maximum(0.0, x[2] - x[0]) * np.maximum(0.0, x[3] - x[1]) for x in (a, b))
    apart = np.hypot((a[0] + a[2]) - (b[0] + b[2]), (a[1] + a[3]) - (b[1] + b[3])) / 2
    near = 1 - apart / (3 * np.maximum(1.0, (np.sqrt(sa) + np.sqrt(sb)) / 2))
    return np.maximum(w * h / np.maximum(1e-6, sa + sb - w * h), np.maximum(0.0, near))


#: Rows of whole pages that are aligned in one go, and pairs scored in one pass.
HELD, PASS = 16_384, 1 << 19


@lru_cache(1 << 17)
def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def products(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For pairs of groups of so many members each pair of members: (pair, place on the left, place on the right), in passes."""
    ends = np.cumsum(left * right)
    for start in range(0, int(ends[-1]) if len(ends) else 0, PASS):
        stop = min(start + PASS, int(ends[-1]))
        lo, hi = np.searchsorted(ends, [start, stop - 1], side="right")
        bounds = np.minimum(ends[lo : hi + 1], stop)
        pair = np.repeat(np.arange(lo, hi + 1), np.diff(bounds, prepend=start))
        at, wide = np.arange(start, stop) - (ends - left * right)[pair], right[pair]
        row = at // wide
        yield pair, row, at - row * wide


def contained(texts: list[str], page: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (shorter, longer) of different texts of which one holds the other, of two characters or more.

    ``page`` and ``text`` are the texts of each page: a short text's parts are
    looked up among all texts, a long one meets the texts of its pages.
    """
    place = {t: k for k, t in enumerate(texts)}
    by = np.argsort(page, kind="stable")
    mates, cuts = text[by].tolist(), np.searchsorted(page[by], np.arange(int(page.max(initial=-1)) + 2))
    by = np.argsort(text, kind="stable")
    homes, ends = page[by], np.searchsorted(text[by], np.arange(len(texts) + 1))
    size, length = np.diff(cuts), list(map(len, texts))
    near = np.add.reduceat(np.append(size[homes], 0), ends[:-1]).tolist() if len(texts) else []
    homes, ends, cuts = homes.tolist(), ends.tolist(), cuts.tolist()
    shorter, longer = [], []
    for k, t in enumerate(texts):
        n = length[k]
        if n * n > 2 * near[k]:
            met = [x for h in homes[ends[k] : ends[k + 1]] for x in mates[cuts[h] : cuts[h + 1]] if 2 <= length[x] < n and texts[x] in t]
            held = set(met)
        else:
            held = {place[u] for i in range(n - 1) for j in range(i + 2, n + 1) if (u := t[i:j]) in place and j - i < n}
        shorter.extend(held)
        longer.extend([k] * len(held))
    return np.array(shorter, np.int64), np.array(longer, np.int64)


class Words:
    """One side's words that have a text, on whole pages: their boxes, and where each text of a page occurs."""

    def __init__(self, rows: np.ndarray, pages: np.ndarray, text: np.ndarray, boxes: list[np.ndarray], most: int):
        self.rows, self.box = rows, [b[rows] for b in boxes]
        codes = pages[rows] * most + text[rows]
        self.by = np.argsort(codes, kind="stable")
        self.codes, self.starts, self.sizes = np.unique(codes[self.by], return_index=True, return_counts=True)
        self.page, self.text = self.codes // most, self.codes % most

    def boxes(self, at: np.ndarray) -> tuple:
        return tuple(b[at] for b in self.box)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code, or -1."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        return np.where(self.codes[at] == codes, at, -1) if len(self.codes) else np.full(len(codes), -1)


class Taken:
    """Of each word the first pair, in the order of scores, that takes it: its score and the word on the other side."""

    def __init__(self, n: int):
        self.score, self.other = np.full(n, -np.inf), np.full(n, -1)

    def take(self, own: np.ndarray, other: np.ndarray, score: np.ndarray) -> None:
        before = self.score.copy()
        np.maximum.at(self.score, own, score)
        self.other[self.score > before] = -1
        top = score == self.score[own]
        np.maximum.at(self.other, own[top], other[top])

    def before(self, own: np.ndarray, other: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Is the word taken before this pair comes?"""
        return (self.score[own] > score) | ((self.score[own] == score) & (self.other[own] > other))


class Alignment:
    """Pairs of words of whole pages, a and b, as :func:`align` takes them.

    Containments take both sides whatever happens, so they come first.  Other
    pairs are taken from the best down.  A pair of unlike texts is only compared
    if the most that it can reach comes before what takes its sides; what was
    compared is added and the pairs are taken anew, until no such pair is left.
    """

    def __init__(self, a: Words, b: Words, texts: list[str], least: float):
        self.a, self.b, self.texts, self.least = a, b, texts, least
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.kept: list[tuple] = []  # pairs of containments: (i, j, score, place of the kind in KINDS)
        self.held = [Taken(len(a.rows)), Taken(len(b.rows))]
        codes = np.union1d(a.codes, b.codes)
        short, long = contained(texts, codes // len(texts), codes % len(texts))
        for one, two, kind in ((a, b, WITHIN), (b, a, AROUND)):
            self._hold(one, two, short, long, kind)
        k = b.find(a.codes)
        self.pairs = self._scored(np.flatnonzero(k >= 0), k[k >= 0], np.ones(int((k >= 0).sum())))

    def _scored(self, k: np.ndarray, m: np.ndarray, text: np.ndarray, free=True) -> tuple:
        """(i, j, score) of all words of pairs of texts that reach the least score and, if ``free``, aren't taken by containments before."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for pair, x, y in products(self.a.sizes[k], self.b.sizes[m]):
            i, j = self.a.by[self.a.starts[k[pair]] + x], self.b.by[self.b.starts[m[pair]] + y]
            score = 0.7 * text[pair] + 0.3 * nearness(self.a.boxes(i), self.b.boxes(j))
            fits = score >= self.least
            if free:
                fits &= ~self.held[0].before(i, j, score) & ~self.held[1].before(j, i, score)
            out.append((i[fits], j[fits], score[fits]))
        return tuple(np.concatenate(c) for c in zip(*out))

    def _hold(self, one: Words, two: Words, short: np.ndarray, long: np.ndarray, kind: str) -> None:
        """Containments of texts of ``one`` in texts of ``two``."""
        first, last = (np.searchsorted(long, two.text, side=s) for s in ("left", "right"))
        holder, _, n = (np.concatenate(c) for c in zip((np.empty(0, np.int64),) * 3, *products(np.ones(len(two.text), np.int64), last - first)))
        inner = short[first[holder] + n]
        within = one.find(two.page[holder] * len(self.texts) + inner)
        found = within >= 0
        within, holder = within[found], holder[found]
        share = self.length[one.text[within]] / self.length[two.text[holder]]
        k, m = (within, holder) if one is self.a else (holder, within)
        i, j, score = self._scored(k, m, np.minimum(CEILING, share + BONUS), free=False)
        self.kept.append((i, j, score, KINDS.index(kind)))
        self.held[0].take(i, j, score)
        self.held[1].take(j, i, score)

    def _greedy(self) -> np.ndarray:
        """Places of the pairs that are taken."""
        i, j, score = self.pairs
        first, other = Taken(len(self.a.rows)), Taken(len(self.b.rows))
        first.take(i, j, score)
        other.take(j, i, score)
        # pairs that are the best of both sides at once, then the others one by one
        best = np.flatnonzero((first.score[i] == score) & (first.other[i] == j) & (other.score[j] == score) & (other.other[j] == i))
        left, right, out = np.zeros(len(self.a.rows), bool), np.zeros(len(self.b.rows), bool), best.tolist()
        left[i[best]] = right[j[best]] = True
        by = np.flatnonzero(~left[i] & ~right[j])
        by = by[np.lexsort((j[by], i[by], score[by]))[::-1]]
        left, right = bytearray(left), bytearray(right)
        for n, x, y in zip(by.tolist(), i[by].tolist(), j[by].tolist()):
            if not left[x] and not right[y]:
                left[x] = right[y] = 1
                out.append(n)
        return np.array(out, np.int64)

    def _alike(self, taken: list[Taken], live: np.ndarray | None) -> tuple:
        """Pairs of unlike texts that come before what takes their sides and aren't known yet."""
        a, b, least = self.a, self.b, self.least
        low, weak = [], []
        for side, t in zip((a, b), taken):
            low.append(np.maximum(least, np.minimum.reduceat(t.score[side.by], side.starts)) if len(side.starts) else np.empty(0))
            n = self.length[side.text]
            # unlike texts share at most all of the shorter one, which is then the shorter by one
            weak.append(np.flatnonzero((low[-1] <= 0.7 * (2.0 * n / (2 * n + 1)) + 0.3 + 1e-9) & (True if live is None else np.isin(side.page, live))))
        first, last = (np.searchsorted(b.page[weak[1]], a.page[weak[0]], side=s) for s in ("left", "right"))
        ks, ms, most = [], [], []
        for pair, _, n in products(np.ones(len(weak[0]), np.int64), last - first):
            k, m = weak[0][pair], weak[1][first[pair] + n]
            na, nb, need = self.length[a.text[k]], self.length[b.text[m]], np.maximum(low[0][k], low[1][m]) - 1e-9
            near = (a.text[k] != b.text[m]) & (0.7 * (2.0 * np.minimum(na, nb) / (na + nb)) + 0.3 >= need)
            k, m, na, nb, need = k[near], m[near], na[near], nb[near], need[near]
            bound = 2.0 * self._shared(a.text[k], b.text[m]) / (na + nb)
            near = 0.7 * bound + 0.3 >= need
            ks.append(k[near]), ms.append(m[near]), most.append(bound[near])
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if ks:
            k, m, bound = map(np.concatenate, (ks, ms, most))
            unlike = np.fromiter((not (len(x) > 1 and x in y or len(y) > 1 and y in x) for x, y in zip((self.texts[t] for t in a.text[k]), (self.texts[t] for t in b.text[m]))), bool, len(k))
            k, m, bound = k[unlike], m[unlike], bound[unlike]
            for pair, x, y in products(a.sizes[k], b.sizes[m]):
                i, j = a.by[a.starts[k[pair]] + x], b.by[b.starts[m[pair]] + y]
                place = nearness(a.boxes(i), b.boxes(j))
                high = 0.7 * bound[pair] + 0.3 * place
                at = np.flatnonzero((high >= least) & (taken[0].score[i] <= high) & (taken[1].score[j] <= high))
                pair, i, j, place = pair[at], i[at], j[at], place[at]
                used, of = np.unique(pair, return_inverse=True)
                text = np.array([ratio(self.texts[a.text[k[p]]], self.texts[b.text[m[p]]]) for p in used.tolist()], float)
                score = 0.7 * text[of] + 0.3 * place
                new = (score >= least) & ~taken[0].before(i, j, score) & ~taken[1].before(j, i, score)
                out.append((i[new], j[new], score[new]))
        i, j, score = (np.concatenate(c) for c in zip(*out))
        if len(i):
            new = ~np.isin(i * len(b.rows) + j, self.pairs[0] * len(b.rows) + self.pairs[1])
            i, j, score = i[new], j[new], score[new]
        return i, j, score

    def _shared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """At least the number of characters that two texts share: characters are counted in 64 classes."""
        used, of = np.unique(np.concatenate([x, y]), return_inverse=True)
        left, right, counts = of[: len(x)], of[len(x) :], np.zeros((len(used), 64), np.int32)
        for row, t in zip(counts, used.tolist()):
            codes = np.frombuffer(self.texts[t].encode("utf-32-le", "surrogatepass"), np.uint32)
            row += np.bincount(codes % 64, minlength=64).astype(np.int32)
        return np.concatenate([np.empty(0, np.int64), *(np.minimum(counts[left[s : s + ROWS]], counts[right[s : s + ROWS]]).sum(1) for s in range(0, len(x), ROWS))])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, score, place of the kind in KINDS) of the pairs taken; i and j are rows as they were given."""
        alike, live = 0, None
        exact = len(self.pairs[0])
        while True:
            best = self._greedy()
            i, j, score = (c[best] for c in self.pairs)
            taken = deepcopy(self.held)
            taken[0].take(i, j, score)
            taken[1].take(j, i, score)
            more = self._alike(taken, live)
            if not len(more[0]):
                break
            # only on pages with new pairs can others come free
            at = np.unique(np.searchsorted(self.a.starts, np.argsort(self.a.by)[more[0]], side="right") - 1)
            live = np.unique(self.a.page[at])
            self.pairs = tuple(map(np.concatenate, zip(self.pairs, more)))
        kinds = np.where(best < exact, KINDS.index(EXACT), KINDS.index(ALIKE)).astype(np.int8)
        i, j, score = (np.concatenate([c, *(h[n] for h in self.kept)]) for n, c in enumerate((i, j, score)))
        kinds = np.concatenate([kinds, *(np.full(len(h[0]), h[3], np.int8) for h in self.kept)])
        return self.a.rows[i], self.b.rows[j], score, kinds


def align(reference: DataFrame, other: DataFrame, page: str, least: float = 0.45) -> DataFrame:
    """(page, ref_id, other_id, score, kind): words of one page aligned by text and place.

    From the best score down, of equals from the highest id; a containment may
    use a side again, any other kind only sides that are still free.  Words
    without letters or digits align with nothing.
    """
    def side(df: DataFrame, own: str, no: str) -> DataFrame:
        return df.select(F.col(page).alias(page), F.col("id").alias(own), F.lit(None).alias(no), F.lit(own == "ref_id").alias("_ours"), F.col("text"), *[F.col(c).cast("double").alias(c) for c in BOX])

    both = side(reference, "ref_id", "other_id").unionByName(side(other, "other_id", "ref_id"))
    key, ri, oi = reference.schema[page].dataType.simpleString(), reference.schema["id"].dataType.simpleString(), other.schema["id"].dataType.simpleString()
    out = both.sparkSession.createDataFrame([], f"{page} {key}, ref_id {ri}, other_id {oi}, score double, kind string").schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_pages(batches, page, HELD):
            i, j, score, kind = aligned(t, page, least)
            columns = t.column(page).take(i), t.column("ref_id").take(i), t.column("other_id").take(j), pa.array(score), pa.DictionaryArray.from_arrays(kind, KINDS)
            yield from pa.table([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow).to_batches(HELD)

    return spread(both, page).sortWithinPartitions(page, "_ours", "ref_id", "other_id").mapInArrow(run, out)


def align_counts(rows: DataFrame, page: str, readings, least: float = 0.45) -> DataFrame:
    """(page, kind, n): how many pairs :func:`align` finds, of words that are made where they are aligned.

    ``readings`` makes of a table of whole pages the words of both readings:
    page, _ours (of the reference?), text and box, by id.  No word is
    shuffled or stored, only ``rows``.
    """
    out = rows.sparkSession.createDataFrame([], f"{page} {rows.schema[page].dataType.simpleString()}, kind string, n bigint").schema
    arrow = to_arrow_schema(out)
    order = [page, *(c for c in rows.columns if c != page)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_pages(batches, page, HELD // 4):
            words = readings(t)
            i, _, _, kind = aligned(words, page, least)
            keys = words.column(page).combine_chunks()
            codes, first, n = np.unique(_codes(keys)[i] * len(KINDS) + kind, return_index=True, return_counts=True)
            columns = keys.take(i[first]), pa.DictionaryArray.from_arrays((codes % len(KINDS)).astype(np.int8), KINDS), pa.array(n)
            yield from pa.table([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow).to_batches()

    return spread(rows, page).sortWithinPartitions(*order).mapInArrow(run, out)


def _codes(keys: pa.Array) -> np.ndarray:
    """A number for each different key, 0 for null."""
    return pc.fill_null(pc.cast(keys.dictionary_encode().indices, pa.int64()), -1).to_numpy() + 1


def whole_pages(batches: Iterator[pa.RecordBatch], page: str, most: int) -> Iterator[pa.Table]:
    """Sorted rows as tables of whole pages, of about ``most`` rows or one page."""
    held, rows, wanted = [], 0, most
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= wanted:
            t = pa.Table.from_batches(held).combine_chunks()
            if cuts := _changes(t.column(page).combine_chunks()):
                yield t.slice(0, cuts[-1])
                t = t.slice(cuts[-1])
            held, rows = t.to_batches(), t.num_rows
            wanted = max(most, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def aligned(words: pa.Table, page: str, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:meth:`Alignment.result` of both readings' words (page, _ours, text, box), each reading by id."""
    pages = _codes(words.column(page).combine_chunks())
    said = pc.fill_null(words.column("text").combine_chunks(), "").dictionary_encode()
    place: dict[str, int] = {}
    text = np.array([place.setdefault(plain(w), len(place)) for w in said.dictionary.to_pylist()], np.int64)[said.indices.to_numpy()]
    some, ours = text != place.get("", -1), words.column("_ours").to_numpy()
    boxes = [words.column(c).to_numpy() for c in BOX]
    a, b = (Words(np.flatnonzero(some & own), pages, text, boxes, len(place)) for own in (ours, ~ours))
    if not len(a.rows) or not len(b.rows):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, float, np.int8))
    return Alignment(a, b, list(place), least).result()
