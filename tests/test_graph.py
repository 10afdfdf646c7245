import random

from pyspark.sql import functions as F

from folioflow.operators.components import connected_components
from folioflow.operators.skew import hot_keys, lookup_join
from folioflow.operators.audit import hamming_groups
from folioflow.plans.catalog import QUERIES


def roots(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_equal_union_find(spark):
    r = random.Random(3)
    edges = [(f"n{r.randrange(300):03}", f"n{r.randrange(300):03}") for _ in range(220)] + [("hub", f"s{i}") for i in range(200)] + [(None, "x"), ("y", None), ("z", "z")]
    edges += [(f"c{i:03}", f"c{i + 1:03}") for i in range(90)]
    random.Random(1).shuffle(edges)
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {k: v for k, v in roots(edges).items() if k != v}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_lookup_join_keeps_every_row_of_a_hot_key(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "k string, v int")
    names = spark.createDataFrame([("hot", 1.0)] + [(f"k{i}", 2.0) for i in range(40)], "name string, w double")
    out = lookup_join(rows, "k", names, "name")
    assert out.columns == ["k", "v", "w"]
    assert [r.n for r in out.groupBy("w").agg(F.count("*").alias("n")).orderBy("w").collect()] == [11, 3000, 40]
    assert lookup_join(rows, "k", names, "name", "inner").count() == 3040
    assert hot_keys(rows, "k", 1).first()[0] == "hot"


def test_hamming_groups_against_all_pairs(spark):
    r = random.Random(5)
    base = [r.getrandbits(63) for _ in range(30)]
    rows = []
    for i, b in enumerate(base):
        for j in range(r.choice([1, 2, 4])):
            h = b
            for _ in range(r.choice([0, 2, 5, 9])):
                h ^= 1 << r.randrange(63)
            rows.append((i * 10 + j, h))
    rows += [(900, None), (901, rows[0][1])]
    pairs = [(a, b) for a, x in rows for b, y in rows if a < b and x is not None and y is not None and bin(x ^ y).count("1") <= 5]
    want = roots(pairs)
    got = {x.id: x.group for x in hamming_groups(spark.createDataFrame(rows, "id int, h long"), "id", "h").collect()}
    assert got == {i: want.get(i, i) for i, _ in rows}


def test_near_duplicates_against_all_pairs(spark, tmp_path):
    """Edits spread over a text move many SimHash bits at a shingle similarity of 0.8; a footer is in every text."""
    r = random.Random(12)
    footer = " please keep this sheet with the box"
    texts: list = [None, "", "  ", "one two", "One  two", "one three"]
    for f in range(30):
        words = [f"w{r.randrange(4000)}" for _ in range(r.choice([30, 80, 200]))]
        for _ in range(5):
            w = list(words)
            for _ in range(r.randrange(1 + len(w) // 40)):
                w[r.randrange(len(w))] = f"x{r.randrange(4000)}"
            texts.append(" ".join(w) + footer)
    sets = [frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else None for t in texts]
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) / len(a | b) >= 0.8 and group[i] != group[j]:
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.class_id for x in QUERIES["near_duplicates"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(group)) and len(set(group)) < 100
    from folioflow.operators.audit import near_text_groups

    assert {x.doc_id: x.group for x in near_text_groups(docs, "doc_id", "text", cell=3).collect()} == got
    assert near_text_groups(docs.limit(0), "doc_id", "text").count() == 0
