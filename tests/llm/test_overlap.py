import random

import numpy as np
from folioflow.llm.overlap import TRAIN, chained, cross_split_classes, cross_split_overlaps, stretches, words
from pyspark.sql import functions as F


def brute_runs(a, b, k):
    """All maximal equal runs of at least k tokens."""
    k, out = min(k, len(a)), set()
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and (i == 0 or j == 0 or a[i - 1] != b[j - 1]):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n >= k:
                    out.add((i, j, n))
    return out


def best_chain(runs):
    """Best sum over all chains, by trying every one."""
    runs = sorted(runs)

    def go(at, end, there, total):
        best = total
        for q in range(at, len(runs)):
            x, y, n = runs[q]
            if end is None:
                best = max(best, go(q + 1, (x, x + n), (y, y + n), n))
            else:
                fresh = n - max(0, end[1] - x, there[1] - y)
                if x > end[0] and y > there[0] and fresh > 0:
                    best = max(best, go(q + 1, (x, x + n), (y, y + n), total + fresh))
        return best

    return go(0, None, None, 0)


def test_stretches_and_chains_equal_brute_force():
    r = random.Random(11)
    for _ in range(150):
        a, b = (np.array([r.randrange(4) for _ in range(r.randrange(1, 16))], np.int64) for _ in range(2))
        k = r.choice([1, 2, 3])
        got = stretches(a, b, k)
        assert {tuple(x) for x in got.tolist()} == brute_runs(a.tolist(), b.tolist(), k)
        if len(got) <= 12:
            assert chained(got) == best_chain(map(tuple, got.tolist()))


def test_a_phrase_at_the_wrong_end_blocks_nothing(spark):
    opening, body = [f"o{i}" for i in range(5)], [f"b{i}" for i in range(60)]
    rows = [(1, opening + body, "test"), (2, body + ["x"] * 3 + opening, "train"), (3, ["y"] * 9, "train")]
    df = spark.createDataFrame(rows, "id int, tok array<string>, split string")
    (hit,) = cross_split_overlaps(df, "id", "tok", "split").collect()
    assert (hit.train_key, hit.eval_key, hit.covered) == (2, 1, 60) and hit.coverage > 0.9


def test_texts_equal_all_pairs_and_copies_are_folded(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    common = [f"c{i}" for i in range(9)]  # a phrase that nearly every text opens with
    base = [[r.choice(vocabulary) for _ in range(50)] for _ in range(10)]
    rows = []
    for i in range(120):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 3, 9])):
            t[r.randrange(len(t))] = r.choice(vocabulary)
        rows.append((i, common * (r.random() < 0.9) + t, "test" if i % 4 == 0 else TRAIN, "s"))
    rows += [(200, None, TRAIN, "s"), (201, [], "test", "s"), (202, base[0], None, "s"), (None, base[0], "test", "s"), (203, common, "test", "s"), (204, base[0], TRAIN, "t"), (205, base[0], "test", "t")]
    df = spark.createDataFrame(rows, "id int, tok array<string>, split string, source string")
    want = {}
    for i, a, s, _ in rows:
        for j, b, t, _ in rows:
            if None not in (i, j) and a and b and s == "test" and t == TRAIN:
                code = {x: n for n, x in enumerate(sorted({*a, *b}))}
                c = chained(stretches(np.array([code[x] for x in a]), np.array([code[x] for x in b]), 5))
                if c >= 0.8 * len(a):
                    want[(j, i)] = c
    got = {(x.train_key, x.eval_key): x.covered for x in cross_split_overlaps(df, "id", "tok", "split", "source", coverage=0.8).collect()}
    assert got == want and len(want) > 50
    pairs, members = cross_split_classes(df, "id", "tok", "split", "source")
    of = {}
    for m in members.collect():
        of.setdefault((m["class"], m.split == TRAIN), []).append(m.key)
    spread = [(t, e, p.covered) for p in pairs.collect() for t in of[(p.train_class, True)] for e in of[(p.eval_class, False)]]
    assert {(t, e): c for t, e, c in spread} == want and len(spread) == len(want)
    assert cross_split_overlaps(df.limit(0), "id", "tok", "split").count() == 0


def test_words_of_odd_texts(spark):
    df = spark.createDataFrame([(None,), ("",), (" .,; ",), ("Ab-c 1",)], "t string")
    assert [r.w for r in df.select(words(F.col("t")).alias("w")).collect()] == [[], [], [], ["ab", "c", "1"]]


PASSAGE = "The committee of the northern harbour met on a cold morning and resolved that every vessel above forty tons should pay a toll for the repair of the old breakwater, which had suffered in the storms of the last two winters."


def test_items_of_any_number_are_found_in_blocks(spark):
    from folioflow.llm.leaks import find_leaks, leaks_of

    other = "Receipt number 4711, three pens, two cups and a box of paper, paid in cash at the desk, thank you and come again soon to our shop in the market street."
    docs = spark.createDataFrame([(1, "Page 7\n" + PASSAGE.upper() + "\nend", "x"), (2, other, "x"), (3, None, "x"), (4, "", "x"), (None, PASSAGE, "x")], "doc_id int, text string, item_id string")
    for copies in (1, 2, 3, 10):
        items = [(n, PASSAGE) for n in range(copies)] + [(50, "Snow fell on the vineyards before the grapes were brought in, so the growers of the valley asked the council to put off the tithe until the spring.")]
        assert {(r.doc_id, r.item_id) for r in find_leaks(docs, "doc_id", "text", items).collect()} == {(1, n) for n in range(copies)}
    held = spark.createDataFrame([(n, PASSAGE if n % 3 == 0 else f"item {n}: short") for n in range(9)] + [(None, PASSAGE)], "item int, passage string")
    want = {(1, 0), (1, 3), (1, 6)}
    for block in (100, 3):
        assert {(r.doc_id, r.item_id) for r in leaks_of(docs, "doc_id", "text", held, "item", "passage", block=block).collect()} == want
    assert {(r.doc_id, r.item_id) for r in leaks_of(docs, "doc_id", "text", held, "item", "passage", exact=True).collect()} == want
    assert leaks_of(docs, "doc_id", "text", held.limit(0), "item", "passage").count() == 0
