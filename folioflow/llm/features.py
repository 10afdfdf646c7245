"""Hashed words of texts, unit by unit, without a Python loop over words."""

from __future__ import annotations

import numpy as np

from folioflow.llm.leaks import _mix, fold_table

# Further characters that recognition confuses, folded for topic words only.
ALIKE = {"c": "e", "f": "t", "a": "o", "q": "g"}
P = np.uint64(0x9E3779B97F4A7C15)
P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WORD, BREAK, SPACE, JOINED = 1, 2, 3, 4
#: Characters of a shingle in scripts written without spaces between words.
JOINED_SHINGLE = 5

_tables: tuple[np.ndarray, np.ndarray] | None = None
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _classes() -> tuple[np.ndarray, np.ndarray]:
    global _tables
    if _tables is None:
        codes = fold_table().copy()
        for a, b in ALIKE.items():
            codes[codes == ord(a)] = ord(b)
        kind = np.where(codes > 0, WORD, SPACE).astype(np.uint8)
        for lo, hi in ((0x0E00, 0x0E80), (0x0E80, 0x0F00), (0x3040, 0xA000)):  # Thai, Lao, kana and ideographs
            kind[lo:hi] = np.where(codes[lo:hi] > 0, JOINED, SPACE)
        kind[[ord("\n"), ord("\r"), 0x2028, 0x2029, 0x0B, 0x0C, 0x85]] = BREAK
        _tables = codes, kind
    return _tables


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        one = np.ones(1, np.uint64)
        _powers = tuple(np.concatenate([one, np.cumprod(np.full(n, p, np.uint64))]) for p in (P, P_INVERSE))
    return _powers


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, unit, feature) of every word and shingle.

    A unit is a line or a sentence and is numbered over all texts.  Words hold
    at least two letters; those that are mostly digits say nothing about a
    subject and are left out.
    """
    full = [t or "" for t in texts]
    raw = np.frombuffer("\n".join(full).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    table, kinds = _classes()
    codes, kind = table[raw].astype(np.uint64), kinds[raw].copy()
    stop = (raw == ord(".")) | (raw == ord("!")) | (raw == ord("?"))
    stop[:-1] &= kind[1:] >= SPACE if len(kind) > 1 else True
    stop &= np.concatenate([[0, 0, 0], kind])[:-3] == WORD  # not after an initial or abbreviation of one letter
    gap = (raw == 32) | (raw == 9)
    beside = np.zeros(len(raw), bool)
    beside[1:] |= kind[:-1] == JOINED
    beside[:-1] |= kind[1:] == JOINED
    breaks = (kind == BREAK) | stop | (gap & beside)  # joined scripts part phrases by spaces
    unit = np.cumsum(breaks)
    ends = np.cumsum([len(t) + 1 for t in full])
    up, down = _power(len(raw) + 1)
    letters = np.concatenate([[0], np.cumsum(codes > 0)])  # characters that are dropped don't count as places
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[letters[:-1]])])

    dropped = (codes == 0) & (kind != BREAK) & _invisible(raw)
    kind = kind.copy()
    inside = (kind == WORD) | dropped
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    digit = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
    n, d = letters[b] - letters[a], digit[b] - digit[a]
    good = (n >= 2) & (2 * d < n)
    h = _mix((total[b] - total[a]) * down[letters[a]])
    joined = kind == JOINED
    run = np.concatenate([[0], np.cumsum(joined)])
    at = np.arange(max(0, len(raw) - JOINED_SHINGLE + 1))
    at = at[(run[at + JOINED_SHINGLE] - run[at]) == JOINED_SHINGLE] if len(at) else at
    hj = _mix((total[at + JOINED_SHINGLE] - total[at]) * down[letters[at]])
    where = np.concatenate([a[good], at])
    features = np.concatenate([h[good], hj])
    return np.searchsorted(ends, where, "right"), unit[where], features


def _invisible(raw: np.ndarray) -> np.ndarray:
    """Zero-width characters and soft hyphens, which don't end a word."""
    return ((raw >= 0x200B) & (raw <= 0x200F)) | (raw == 0xFEFF) | (raw == 0xAD) | (raw == 0x2060)
