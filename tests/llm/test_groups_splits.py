import random

import pytest

from folioflow.llm.groups import group_records, hash_to_min
from folioflow.llm.sample import extend_numbers, golden_fraction, golden_sample, key_number
from folioflow.llm.splits import PROPORTIONS, ComponentTable
from pyspark.sql import functions as F

LINKS = "k string, links array<string>, component string, root string"


def brute(records):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, names in records:
        for n in names or []:
            parent[find(("r", k))] = find(("n", n))
    out = {}
    for k, names in records:
        if k is not None and names:
            out.setdefault(find(("r", k)), set()).add(k)
    return {k: min(v) for v in out.values() if len(v) > 1 for k in v}


def made(seed, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        names = [f"g{r.randrange(160)}"] * (r.random() < 0.7) + [f"h{r.randrange(200)}"] * (r.random() < 0.4) + ["hot"] * (r.random() < 0.3)
        rows.append((f"p{i:04}", names))
    return rows


def test_groups_equal_brute_force(spark):
    rows = made(1) + [("q1", []), ("q2", None), (None, ["g1"])]
    df = spark.createDataFrame([(k, n, "x", "y") for k, n in rows], LINKS)
    got = {r.k: r.group_key for r in group_records(df, "k", "links").collect()}
    assert got == brute([x for x in rows if x[0] is not None])


def test_hash_to_min_of_chains_loops_and_nothing(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    pairs = chain + chain[:5] + [("z", "z"), (None, "a"), ("b", None)]
    got = {r.node: r.root for r in hash_to_min(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}
    assert got == {**{f"n{i:03}": "n000" for i in range(61)}, "z": "z"}
    assert hash_to_min(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def records(spark, rows):
    return spark.createDataFrame(rows, "id string, names array<string>, split string, component string")


def table(store):
    return {r.component: r for r in store.components.collect()}


def test_components_are_kept_merged_and_quarantined(spark, tmp_path):
    store = ComponentTable(spark, "file://" + str(tmp_path / "c"))
    first = store.add(records(spark, [("a", ["x"], "train", ""), ("b", ["x", "y"], None, ""), ("c", ["z"], "test", ""), ("d", [], None, ""), ("e", None, None, ""), (None, ["x"], "test", "")]), "id", "names", "split")
    comp = {r.id: r.component for r in first.collect()}
    t = table(store)
    assert comp["a"] == comp["b"] and t[comp["a"]].split == "train" and t[comp["a"]].state == "kept"
    assert t[comp["c"]].split == "test" and comp["d"] != comp["e"] and t[comp["d"]].split in PROPORTIONS
    # a new record joins an old component: the component keeps its split
    second = {r.id: r.component for r in store.add(records(spark, [("f", ["y", "w"], None, "")]), "id", "names", "split").collect()}
    assert table(store)[second["f"]].split == "train" and table(store)[second["f"]].records == 3
    # a record that joins two components of different splits: quarantine, one split for all
    third = {r.id: r.component for r in store.add(records(spark, [("g", ["w", "z"], None, "")]), "id", "names", "split").collect()}
    merged = table(store)[third["g"]]
    assert merged.quarantined and merged.state == "quarantined" and merged.records == 5 and merged.split in PROPORTIONS
    members = {r.node: r.component for r in store.members.collect()}
    assert {members[n] for n in "xyzw"} == {third["g"]}
    # an empty batch changes nothing
    before = {c: (r.split, r.records) for c, r in table(store).items()}
    store.add(records(spark, []), "id", "names", "split")
    assert {c: (r.split, r.records) for c, r in table(store).items()} == before


def test_free_components_fill_the_proportions(spark, tmp_path):
    store = ComponentTable(spark, "file://" + str(tmp_path / "c"))
    rows = [(f"t{i}", [f"t{i % 900}"], "train", "") for i in range(1000)] + [(f"n{i}", [f"n{i // 3}"], None, "") for i in range(3000)] + [(f"h{i}", ["hot"], None, "") for i in range(600)]
    placed = store.add(records(spark, rows), "id", "names", "split")
    got = placed.join(store.components, "component")
    assert got.groupBy("component").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    share = {r.split: r.n / 4600 for r in got.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert all(abs(share[s] - p) < 0.02 for s, p in PROPORTIONS.items() if s != "validation") and abs(share["validation"] - 0.15) < 0.03


def test_sample_is_the_same_in_every_layout_and_keeps_its_members(spark):
    small = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1).alias("number"))
    large = spark.range(9000).repartition(7).select(F.concat(F.lit("k"), "id").alias("k"))
    a = {r.k for r in golden_sample(small, key_number(F.col("k")), 0.1).collect()}
    b = {r.k for r in golden_sample(large, key_number(F.col("k")), 0.1).collect()}
    assert a <= b and a == {k for k in b if int(k[1:]) < 3000} and abs(len(b) / 9000 - 0.1) < 0.02
    assert a <= {r.k for r in golden_sample(small, key_number(F.col("k")), 0.2).collect()}
    assert golden_sample(spark.createDataFrame([(None,)], "k string"), key_number(F.col("k")), 1.0).count() == 0


def test_fractions_are_exact_and_dense_numbers_are_even(spark):
    from folioflow.llm.sample import ONE, SHIFT, STEP

    numbers = [0, 1, 2, 12345, (1 << 47) + 99, (1 << 48) - 1]
    got = [r.f for r in spark.createDataFrame([(n,) for n in numbers], "n long").select(golden_fraction(F.col("n")).alias("f")).collect()]
    assert got == [((n * STEP + int(SHIFT * ONE)) % ONE) / ONE for n in numbers]
    taken = [r.n for r in golden_sample(spark.range(1000).withColumnRenamed("id", "n"), F.col("n"), 0.1).collect()]
    per = [sum(i * 100 <= n < i * 100 + 100 for n in taken) for i in range(10)]
    assert max(per) - min(per) <= 2  # even over every stretch


def test_stored_numbers_grow_and_never_change(spark):
    day = lambda n, at: spark.createDataFrame([(f"f{i:03}", at) for i in n], "k string, at int")
    first = {r.k: r.number for r in extend_numbers(day(range(50), 1), "k", ["at"]).collect()}
    assert sorted(first.values()) == list(range(50))
    known = spark.createDataFrame(list(first.items()), "k string, number long")
    both = {r.k: r.number for r in extend_numbers(day(range(80), 2).union(day([10], 1)), "k", ["at"], known).collect()}
    assert all(both[k] == n for k, n in first.items()) and sorted(both.values()) == list(range(80))


def test_number_zero_is_a_number_and_reopened_tables_go_on(spark, tmp_path):
    from folioflow.llm.sample import NumberTable, sampled

    one = spark.createDataFrame([("a", 1)], "k string, at int")
    known = extend_numbers(one, "k", ["at"])
    assert {r.k: r.number for r in extend_numbers(spark.createDataFrame([("b", 1)], "k string, at int"), "k", ["at"], known).collect()} == {"a": 0, "b": 1}
    path = "file://" + str(tmp_path / "n")
    first = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(2).alias("at"))
    later = first.union(spark.range(2000, 6000).select(F.concat(F.lit("j"), "id").alias("k"), F.lit(1).alias("at"))).repartition(5)
    a = {r.k for r in sampled(first, "k", ["at"], NumberTable(spark, path)).collect()}
    b = {r.k for r in sampled(later, "k", ["at"], NumberTable(spark, path)).collect()}  # the table opened again; late keys sort first
    assert a == {k for k in b if k[0] == "k"} and a == {r.k for r in sampled(first, "k", ["at"], NumberTable(spark, path)).collect()}
    assert abs(len(a) - 200) <= 2 and abs(len(b) - 600) <= 2  # even over both stretches
    numbers = sorted(r.number for r in NumberTable(spark, path).extend(later, "k", ["at"]).collect())
    assert numbers == list(range(6000))
    empty = spark.createDataFrame([(None, 1)], "k string, at int")
    assert sampled(empty, "k", ["at"], NumberTable(spark, "file://" + str(tmp_path / "e"))).count() == 0


def test_a_table_opened_again_goes_on_and_keeps_its_splits(spark, tmp_path):
    path = "file://" + str(tmp_path / "c")
    ComponentTable(spark, path).add(records(spark, [("a", ["x"], "train", ""), ("b", ["y"], None, ""), ("c", ["z"], "test", "")]), "id", "names", "split")
    one = {r.rec: r for r in ComponentTable(spark, path).assignments().collect()}
    again = ComponentTable(spark, path)
    assert again.version == 1
    # a comes again and is left as it was; d joins y; e joins x and z, which are torn
    again.add(records(spark, [("a", ["z"], "test", ""), ("d", ["y"], None, ""), ("e", ["x", "z"], None, ""), ("f", ["x"], None, "")]), "id", "names", "split")
    two = {r.rec: r for r in ComponentTable(spark, path).assignments().collect()}
    assert two["b"].split == one["b"].split == two["d"].split and not two["b"].quarantined
    assert {two[k].split for k in "acef"} == {"train"} and all(two[k].quarantined for k in "acef") and two["a"].named == ["test", "train"]
    met = again.store.table("quarantine").collect()
    assert [(sorted(r.splits), r.split, r.version) for r in met] == [(["test", "train"], "train", 2)]
    # a third batch of one page moves nobody else
    ComponentTable(spark, path).add(records(spark, [("g", ["y", "w"], "private_test", "")]), "id", "names", "split")
    three = {r.rec: r for r in ComponentTable(spark, path).assignments().collect()}
    assert all(three[k].split == two[k].split for k in two)
    with pytest.raises(Exception):
        again.store.add({}, {}, 2)  # another writer has taken version 3


def test_no_name_of_a_record_is_cut(spark, tmp_path):
    names = [f"n{i:04}" for i in range(1500)]
    rows = [("a", names, "train", ""), ("b", [names[-1]], None, ""), ("c", [names[1200]], None, "")]
    t = ComponentTable(spark, "file://" + str(tmp_path / "m"))
    assert len({r.component for r in t.add(records(spark, rows), "id", "names", "split").collect()}) == 1
    got = group_records(records(spark, rows).select("id", "names"), "id", "names")
    assert {r.id: r.group_key for r in got.collect()} == {"a": "a", "b": "a", "c": "a"}
