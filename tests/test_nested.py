import json

from hypothesis import given, settings, strategies as st

from folioflow.operators import shredding as S
from folioflow.operators.drift import advance, assign, profile, profiles, schema_changes
from folioflow.plans.nested import parse_object, relation_schema
from pyspark.sql import functions as F

leaf = st.one_of(st.none(), st.integers(-5, 5))
inner = st.one_of(st.none(), st.dictionaries(st.sampled_from("xyz"), leaf, max_size=3))
record = st.one_of(st.none(), st.fixed_dictionaries({}, optional={"a": st.one_of(st.none(), st.dictionaries(st.text(max_size=2), st.one_of(st.none(), st.fixed_dictionaries({}, optional={"n": leaf, "m": inner})), max_size=3)), "l": st.one_of(st.none(), st.lists(st.one_of(st.none(), st.fixed_dictionaries({"p": st.one_of(st.none(), st.text(max_size=2))})), max_size=3))}))
SCHEMA = S.Group({"a": S.Repeated(S.Group({"n": S.Leaf(), "m": S.Repeated(S.Leaf(), "deep")}), "top"), "l": S.Repeated(S.Group({"p": S.Leaf()}), "list", ("p",))})


@settings(max_examples=200, deadline=None)
@given(st.lists(record, max_size=6))
def test_assembly_gives_every_entry_with_its_parent(records):
    s = S.Striper(SCHEMA)
    for r in records:
        s.add(r)
    got = sorted(((p.node.child, *row[:5], json.dumps(row[5])) for p in s.places for row in s.table(p)), key=repr)
    want = []
    for i, r in enumerate(records):
        for j, (k, v) in enumerate(((r or {}).get("a") or {}).items()):
            if v is not None:
                want.append(("top", i, j, None, None, k, json.dumps({"n": v["n"]} if v.get("n") is not None else {})))
        deep = [(j, k, k2, v2) for j, (k, v) in enumerate(((r or {}).get("a") or {}).items()) for k2, v2 in ((v or {}).get("m") or {}).items()]
        for e, (j, k, k2, v2) in enumerate(deep):
            if v2 is not None:
                want.append(("deep", i, e, j, k, k2, json.dumps({"value": v2})))
        for e, x in enumerate((r or {}).get("l") or []):
            if x is not None:
                want.append(("list", i, e, None, None, x["p"], json.dumps({"p": x["p"]} if x["p"] is not None else {})))
    assert got == sorted(want, key=repr)


def test_levels_are_those_of_dremel():
    s = S.Striper(S.Group({"a": S.Repeated(S.Group({"b": S.Repeated(S.Leaf(), "b")}), "a")}))
    s.add({"a": {"x": {"b": {"p": 1, "q": 2}}, "y": {"b": {}}, "z": None}})
    s.add({"a": {}})
    s.add(None)
    value = s.columns[-1]
    assert value.r == [0, 2, 1, 1, 0, 0]
    assert [d for d in value.d] == sorted([value.d[0]] * 2 + value.d[2:], reverse=True)


def test_shapes_of_collections_and_bad_payloads(spark):
    cls = {"KEY": {"tp": 1}, "NONE": None}
    rows = [
        (1, json.dumps({"per_class": cls, "by_dataset": {"d": {"metrics": {"relation_per_class": json.dumps(cls)}}}})), (2, json.dumps({"per_class": [{"class": "KEY", "tp": 2}, None]})), (3, "{broken"), (4, None), (5, "[1]"), (6, json.dumps({"per_class": "text"})), (7, json.dumps({"per_class": {}})),
    ]
    df = spark.createDataFrame(rows, "report_id long, payload string").withColumn("child", F.lit("clash"))
    got = {(r.record_id, r.child, r.parent_key, r.child_key) for r in S.shred(df, "report_id", "payload", relation_schema, parse_object).collect()}
    assert got == {(1, "class", None, "KEY"), (1, "dataset", None, "d"), (1, "dataset_class", "d", "KEY"), (2, "class", None, "KEY")}
    assert S.shred(df.limit(0), "report_id", "payload", relation_schema, parse_object).count() == 0


def changes_of(files):
    state, out = None, []
    for f in files:
        cur = profile(f, frozenset({"per_class"}))
        found = []
        state = advance({} if state is None else state, cur, (), found if state is not None else [])
        out.append(sorted((".".join(p), k) for p, k, _, _ in found))
    return out


def test_kinds_of_change():
    files = [
        {"a": 1, "o": {"x": 1}, "per_class": {"K": 1}}, {"a": 2.0, "o": {"x": "1"}, "per_class": {"L": 1}}, {"b": 2, "o": {"x": None, "y": [1]}}, {"b": 2, "o": None, "per_class": {}}, {"b": "2", "o": {"x": 3, "y": []}, "per_class": {}},
        {"b": "2", "p": {"q": 1}, "per_class": None},
    ]
    got = changes_of(files)
    assert got[1] == [("o.x", "type")]
    assert got[2][0] in (("a", "removed"), ("a", "renamed")) and ("o.y", "added") in got[2]
    assert got[3] == [("per_class", "added")]
    assert got[4] == [("b", "type"), ("o.x", "type")]
    assert got[5] == [("o", "renamed")]


def test_matching_is_optimal():
    assert assign([[0.9, 0.8], [0.85, 0.1]]) == [(0, 1), (1, 0)]
    assert assign([[0.2], [0.9], [0.3]]) == [(1, 0)]


def test_changes_don_t_depend_on_the_ranges(spark):
    """A stream that is cut into many ranges gives the changes of one that isn't."""
    import random

    r = random.Random(2)
    rows = []
    for i in range(300):
        o = {"v": r.choice([1, "1", None]), **({"w": 1} if r.random() < 0.6 else {}), "o": r.choice([{"x": 1}, {"y": 1}, {"x": None}, None])}
        rows.append(("big" if i % 3 else f"s{i % 7}", i, i, json.dumps(o) if i % 20 else "{"))
    df = spark.createDataFrame(rows, "stream string, at int, report_id int, payload string")
    p = profiles(df, "stream", "at", "report_id", "payload", parse_object, ())
    keys = ("stream", "report_id", "earlier_id", "field_path", "change_kind", "new_path")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        many = sorted(tuple(x[k] for k in keys) for x in schema_changes(p).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    state, want = {}, []
    for s, _, rid, text in rows:
        v = parse_object(text)
        if v is None:
            continue
        cur, found = profile(v, frozenset()), []
        if s in state:
            nxt = advance(state[s][0], cur, (), found)
            want += [(s, rid, state[s][1], ".".join(a), k, ".".join(b) if b else None) for a, k, b, _ in found]
        else:
            nxt = advance({}, cur, (), [])
        state[s] = (nxt, rid)
    assert many == sorted(want) and len(want) > 100


def test_no_files_no_changes(spark):
    df = spark.createDataFrame([], "stream string, at int, report_id int, payload string")
    assert schema_changes(profiles(df, "stream", "at", "report_id", "payload", parse_object, ())).count() == 0


def test_records_keep_their_own_leaves_whatever_their_shape(spark):
    """Fields outside collections come out too, with no list of names, and the same for every batch size."""
    from folioflow.plans.nested import parse_object, relation_schema

    texts = ['{"unheard_of": {"deep": 1.5, "x": null}, "split": "test", "per_class": {"A": {"f1": 1, "more": [1, 2]}}}', '{"unheard_of": 7, "by_dataset": []}', "{}", "[1]", "no json", None]
    df = spark.createDataFrame(list(enumerate(texts)), "report_id long, payload string").coalesce(1)
    want = {
        (0, "", None): {"unheard_of.deep": "1.5", "split": "test"}, (0, "class", "A"): {"f1": "1", "more": "[1, 2]"}, (1, "", None): {"unheard_of": "7"}, (2, "", None): {},
    }
    for rows in (1, 2, 100):
        got = S.shred(df, "report_id", "payload", relation_schema, parse_object, rows, records=True).collect()
        assert {(r.record_id, r.child, r.child_key): r.fields for r in got} == want and len(got) == len(want)
    struct = spark.createDataFrame([(1, (2.0, {"k": 1})), (2, None)], "id long, row struct<a: double, m: map<string, long>>")
    got = S.shred(struct, "id", "row", S.schema_of(struct.schema["row"].dataType, {"m": ("m", ())}), records=True).collect()
    assert {(r.record_id, r.child, r.child_key, tuple(r.fields.items())) for r in got} == {(1, "", None, (("a", "2.0"),)), (1, "m", "k", (("value", "1"),))}


def test_weak_pairs_of_several_fields_are_no_renames():
    from folioflow.operators.drift import _fresh, advance, profile

    def changes(old, new):
        out = []
        advance({n: _fresh(e) for n, e in profile(old, frozenset()).items()}, profile(new, frozenset()), (), out)
        return {(".".join(p), kind, ".".join(q) if q else None) for p, kind, q, _ in out}

    assert changes({"alpha_count": 3}, {"zzz": "text"}) == {("alpha_count", "renamed", "zzz")}  # one for one
    assert changes({"row_count": 3, "model_name": "a"}, {"modelName": "a", "rows_count": 3}) == {("row_count", "renamed", "rows_count"), ("model_name", "renamed", "modelName")}
    assert changes({"alpha_count": 3, "model_name": "a"}, {"modelName": "a", "zzz": ["x"]}) == {("model_name", "renamed", "modelName"), ("alpha_count", "removed", None), ("zzz", "added", None)}
