"""Training noise: what recognition does to a token, and seeded made-up texts."""

from __future__ import annotations

import random
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Characters that are confused, in the order in which they are tried.
CONFUSIONS = (("0", "O"), ("O", "0"), ("1", "I"), ("I", "1"), ("l", "1"), ("5", "S"), ("S", "5"), ("8", "B"), ("B", "8"))


def _swap_first(text: Column, old: str, new: str) -> Column:
    at = F.instr(text, old)
    return F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + 1, F.length(text)))


def confuse(text: Column) -> Column:
    """The first confusion that applies, once; NULL where none does."""
    out = F.lit(None).cast("string")
    for old, new in reversed(CONFUSIONS):
        out = F.when(F.contains(text, F.lit(old)), _swap_first(text, old, new)).otherwise(out)
    return out


def drop_mark(text: Column) -> Column:
    """Without its first dash, slash or colon; NULL where there is none or nothing else is left."""
    at = F.regexp_instr(text, F.lit("[-/:]"))
    out = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text)))
    return F.when((at > 0) & (F.trim(out) != ""), out)


def respace(text: Column) -> Column:
    """Its first space dropped, or a long word cut in the middle; else NULL."""
    mid = F.floor(F.length(text) / 2).cast("int")
    cut = F.concat(F.substring(text, F.lit(1), mid), F.lit(" "), F.substring(text, mid + 1, F.length(text)))
    return F.when(F.contains(text, F.lit(" ")), _swap_first(text, " ", "")).when((F.length(text) >= 6) & text.rlike(r"^[\p{L}\p{N}]+$"), cut)


def swap_decimal(text: Column) -> Column:
    """Point and comma exchanged in the first decimal; NULL where there is none."""
    at = F.regexp_instr(text, F.lit(r"\d[.,]\d{1,2}(?!\d)")) + 1
    mark = F.when(F.substring(text, at, F.lit(1)) == ".", ",").otherwise(".")
    return F.when(at > 1, F.concat(F.substring(text, F.lit(1), at - 1), mark, F.substring(text, at + 1, F.length(text))))


def _generator(identity: str, seed: int) -> random.Random:
    return random.Random(int.from_bytes(sha256(f"{seed}|{identity}".encode()).digest()[:8], "big"))


def noisy(identity: Column, tokens: Column, seed: int = 42, chance: float = 0.5, share: float = 0.1, most: int = 3) -> Column:
    """Tokens with one to ``most`` of them disturbed, for a seeded share of the rows; NULL for the others.

    The draws belong to the identity, so reruns and layouts agree.
    """

    def disturb(t: str, rng: random.Random) -> str | None:
        kinds = list(range(3))
        rng.shuffle(kinds)
        for k in kinds:
            if k == 0:
                hit = next(((a, b) for a, b in CONFUSIONS if a in t), None)
                if hit:
                    return t.replace(hit[0], hit[1], 1)
            elif k == 1:
                at = next((i for i, c in enumerate(t) if c in "-/:"), -1)
                if at >= 0 and (t[:at] + t[at + 1 :]).strip():
                    return t[:at] + t[at + 1 :]
            elif len(t) >= 6 and t.isalnum():
                return t[: len(t) // 2] + " " + t[len(t) // 2 :]
        return None

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(ids: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for i, row in zip(ids, rows):
            words = [] if row is None else list(row)
            usable = [k for k, w in enumerate(words) if w and w.strip()]
            rng = _generator(str(i), seed)
            if not usable or rng.random() >= chance:
                out.append(None)
                continue
            changed = 0
            for k in rng.sample(usable, rng.randint(1, max(1, min(most, round(len(usable) * share))))):
                new = disturb(words[k], rng)
                if new is not None:
                    words[k], changed = new, changed + 1
            out.append(words if changed else None)
        return pd.Series(out)

    return run(identity.cast("string"), tokens)


def made_up_text(number: Column, templates: list[str], seed: int = 42) -> Column:
    """Seeded texts of templates with {amount}, {number}, {day}, {month} and {year}."""

    @F.pandas_udf(T.StringType())
    def run(numbers: pd.Series) -> pd.Series:
        out = []
        for n in numbers:
            rng = _generator(str(n), seed)
            out.append(templates[int(n) % len(templates)].format(amount=f"{rng.uniform(1, 9999):,.2f}", number=rng.randint(10_000, 999_999), day=f"{rng.randint(1, 28):02d}", month=f"{rng.randint(1, 12):02d}", year=rng.randint(2018, 2026)))
        return pd.Series(out)

    return run(number)
