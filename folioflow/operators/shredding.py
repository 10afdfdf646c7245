"""Nested records into related flat tables: columnar shredding and assembly.

Records are striped into one column per leaf path, each a sequence of
(repetition level, definition level, value), as in Dremel.  The rows of every
repeated ancestor are then put together again from the level sequences of the
columns below it: an entry begins wherever a column repeats at the ancestor's
level or above, and counting entries gives the link to the parent.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

CHILD_SCHEMA = "record_id bigint, child string, entry int, parent_entry int, parent_key string, child_key string, fields map<string,string>"


@dataclass
class Leaf:
    """A value; anything but a scalar is kept as its JSON text."""


@dataclass
class Group:
    """An object with named fields; ``own`` keeps values at its place that are no object."""

    fields: dict[str, Node]
    own: bool = False


@dataclass
class Repeated:
    """A collection of (key, value) entries; ``child`` names its table.

    Objects and maps give their items.  An array gives its elements; where
    ``key_fields`` is given, an element's key is the first of these fields that
    it has.  Text that holds such a collection as JSON is read.
    """

    value: Node
    child: str = ""
    key_fields: tuple[str, ...] = ()


Node = Leaf | Group | Repeated


def schema_of(dtype: T.DataType, children: dict[str, tuple[str, tuple[str, ...]]], path: str = "") -> Node:
    """The node of a Spark type; ``children`` maps a path to (table, key fields)."""
    if isinstance(dtype, T.StructType):
        return Group({f.name: schema_of(f.dataType, children, f"{path}.{f.name}".lstrip(".")) for f in dtype})
    if isinstance(dtype, (T.MapType, T.ArrayType)):
        inner = dtype.valueType if isinstance(dtype, T.MapType) else dtype.elementType
        child, keys = children.get(path, (path, ()))
        return Repeated(schema_of(inner, children, f"{path}[]"), child, keys)
    return Leaf()


def infer(values: list, children: dict[str, tuple[str, tuple[str, ...]]], path: str = "", repeated: bool = True) -> Node:
    """The node that holds all of ``values`` (parsed JSON), whatever fields they have.

    ``children`` maps the paths of collections to (table, key fields); below a
    collection the path goes on with ``[]``.  All else follows from the data:
    objects are groups of all fields that any of them has, other values leaves.
    """
    if repeated and path in children:
        child, keys = children[path]
        inner = [v for x in values for _, v in entries(x, keys) or () if v is not None]
        return Repeated(infer(inner, children, f"{path}[]", False), child, keys)
    objects = [v for v in values if isinstance(v, dict)]
    if not objects:
        return Leaf()
    below: dict[str, list] = {}
    for o in objects:
        for k, v in o.items():
            below.setdefault(k, []).append(v)
    for p in children:  # collections are there even where no record has them
        head, _, last = p.rpartition(".")
        if head == path and last not in below and not last.endswith("[]"):
            below[last] = []
    at = f"{path}." if path else ""
    return Group({k: infer([x for x in v if x is not None], children, at + k) for k, v in below.items()}, any(v is not None and not isinstance(v, dict) for v in values))


@dataclass
class Column:
    """The striped values of one leaf path; ``r`` = 0 begins a record."""

    path: tuple[str, ...]
    r: list[int] = field(default_factory=list)
    d: list[int] = field(default_factory=list)
    v: list = field(default_factory=list)


@dataclass
class Place:
    """A repeated ancestor: its levels, its columns and its parent."""

    node: Repeated
    r: int
    d: int  # an entry exists
    d_value: int  # ... and its value isn't null
    parent: Place | None
    key: Column
    columns: list[Column] = field(default_factory=list)
    probe: Column | None = None  # any column below the value


class Striper:
    """Stripes records of one schema and assembles their tables."""

    def __init__(self, schema: Node):
        self.columns: list[Column] = []
        self.outside: list[Column] = []  # of the record itself, below no repeated ancestor
        self.places: list[Place] = []
        self.records = 0
        self.root = self._plan(schema, (), 0, 0, None)

    def _column(self, path: tuple[str, ...], place: Place | None, inner: bool = True) -> Column:
        c = Column(path)
        self.columns.append(c)
        if place is None and inner:
            self.outside.append(c)
        elif inner:
            place.columns.append(c)
        return c

    def _plan(self, node: Node, path: tuple[str, ...], r: int, d: int, place: Place | None):
        """A tree of writers with the levels fixed; every optional step adds one to d."""
        if isinstance(node, Leaf):
            return ("leaf", self._column(path, place), d + 1)
        if isinstance(node, Group):
            own = ("leaf", self._column(path, place), d + 1) if node.own or not node.fields else None
            return ("group", {k: self._plan(v, (*path, k), r, d + 1, place) for k, v in node.fields.items()}, d + 1, own)
        here = Place(node, r + 1, d + 2, d + 3, place, self._column((*path, "key"), place, False))
        self.places.append(here)
        first = len(self.columns)
        value = self._plan(node.value, (*path, "value"), r + 1, d + 2, here)
        here.probe = self.columns[first]
        return ("repeated", here, value, self.columns[first - 1 : len(self.columns)], d + 1)

    def add(self, record) -> None:
        self.records += 1
        self._write(self.root, record, 0, 0)

    def _columns(self, plan) -> list[Column]:
        if plan[0] == "leaf":
            return [plan[1]]
        if plan[0] == "group":
            return [c for p in (*plan[1].values(), *filter(None, plan[3:])) for c in self._columns(p)]
        return plan[3]

    def _nothing(self, plan, r: int, d: int) -> None:
        for c in self._columns(plan):
            c.r.append(r)
            c.d.append(d)
            c.v.append(None)

    def _write(self, plan, value, r: int, d: int) -> None:
        kind = plan[0]
        if kind == "repeated":
            here, inner, columns, present = plan[1], plan[2], plan[3], plan[4]
            items = entries(value, here.node.key_fields)
            if not items:
                return self._nothing(plan, r, d if items is None else present)
            for n, (k, v) in enumerate(items):
                level = here.r if n else r
                here.key.r.append(level)
                here.key.d.append(here.d + (k is not None))
                here.key.v.append(k)
                self._write(inner, v, level, here.d)
        elif value is None:
            self._nothing(plan, r, d)
        elif kind == "group" and not isinstance(value, dict):
            for p in plan[1].values():
                self._nothing(p, r, d)
            if plan[3]:
                self._write(plan[3], value, r, d)
        elif kind == "leaf":
            plan[1].r.append(r)
            plan[1].d.append(plan[2])
            plan[1].v.append(value)
        else:
            for k, p in plan[1].items():
                self._write(p, value.get(k), r, plan[2])
            if plan[3]:
                self._nothing(plan[3], r, plan[2])

    def rows(self) -> Iterator[tuple[int, dict]]:
        """(record, {field: value}) of every record: what lies below no repeated ancestor."""
        for i in range(self.records):
            yield i, {".".join(c.path) or "value": c.v[i] for c in self.outside if c.v[i] is not None}

    def table(self, place: Place) -> Iterator[tuple]:
        """(record, entry, parent entry, parent key, key, {field: value}) per entry with a value.

        Entries are counted within their record; an entry whose value is null
        keeps its number but has no row.
        """
        r, d = np.array(place.probe.r, np.int32), np.array(place.probe.d, np.int32)
        begins = (r <= place.r) & (d >= place.d)
        record = np.cumsum(r == 0) - 1
        rec = record[begins]
        entry = np.arange(len(rec)) - np.searchsorted(rec, rec, "left")
        parent_key = parent_entry = None
        if place.parent is not None:
            up = np.cumsum((r <= place.parent.r) & (d >= place.parent.d))[begins] - 1
            kr, kd = np.array(place.parent.key.r, np.int32), np.array(place.parent.key.d, np.int32)
            at = np.flatnonzero((kr <= place.parent.r) & (kd >= place.parent.d))
            parent_key = [place.parent.key.v[i] for i in at[up]]
            owner = (np.cumsum(kr == 0) - 1)[at]
            parent_entry = up - np.searchsorted(owner, owner[up], "left")
        named = np.array(place.key.d, np.int32) >= place.d
        keys = [place.key.v[i] for i in np.flatnonzero(named)]
        cells = []
        for c in place.columns:
            cr, cd = np.array(c.r, np.int32), np.array(c.d, np.int32)
            at = np.flatnonzero((cr <= place.r) & (cd >= place.d))
            cells.append((".".join(c.path[c.path.index("value", _last_key(place)) + 1 :]) or "value", [c.v[i] for i in at]))
        full = d[begins] >= place.d_value
        for i in range(len(rec)):
            if full[i]:
                yield (
                    int(rec[i]), int(entry[i]), None if parent_entry is None else int(parent_entry[i]), None if parent_key is None else parent_key[i],
                    keys[i], {name: v[i] for name, v in cells if v[i] is not None},
                )


def _last_key(place: Place) -> int:
    return len(place.key.path) - 1


def entries(value, key_fields: tuple[str, ...]) -> list[tuple] | None:
    """(key, value) entries of a collection in whatever shape; None where there is none."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return None
    if isinstance(value, dict):
        return list(value.items())
    if not isinstance(value, (list, tuple)):
        return None
    if value and all(isinstance(x, tuple) for x in value):
        return list(value)  # a map column
    key = lambda x: next((str(x[k]) for k in key_fields if isinstance(x, dict) and x.get(k) is not None), None)
    return [(key(x), x) for x in value]


def _text(v) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str)


def shred(df: DataFrame, record_id: str, column: str, schema: Callable[[list], Node] | Node, parse: Callable | None = None, batch_rows: int = 2000, records: bool = False) -> DataFrame:
    """All child tables of the nested ``column``: one row per entry of a repeated ancestor.

    With ``records`` also one row per record, with the empty ``child``, no
    entry and no key, whose ``fields`` are the leaves below no repeated
    ancestor.  ``child`` names the table of the others, ``entry`` the entry within its record,
    ``parent_entry``/``parent_key`` the entry of the enclosing repeated
    ancestor (NULL where the child hangs on the record itself), ``fields`` the
    leaves of the entry that aren't null, as text.  ``parse`` turns a cell into
    Python values first (None: a record without children).  Null columns, null
    or empty collections and null entries have no rows; keys may hold any
    character; repeated keys in arrays stay separate entries.  ``schema`` is a
    node, or makes one of a batch's parsed values (see :func:`infer`); as every
    value keeps its own path, the rows don't depend on the batch.  Each batch is
    striped and assembled where it lies, without a shuffle.
    """
    rows = df.select(record_id, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch_rows):
                b = whole.slice(start, batch_rows)
                ids, cells = b.column(0).to_pylist(), b.column(1).to_pylist()
                values = [parse(cell) for cell in cells] if parse else cells
                stripes = Striper(schema(values) if callable(schema) else schema)
                for value in values:
                    stripes.add(value)
                out = [{"record_id": ids[rec], "child": "", "entry": None, "parent_entry": None, "parent_key": None, "child_key": None, "fields": [(n, _text(v)) for n, v in f.items()]} for rec, f in (stripes.rows() if records else ()) if values[rec] is not None]
                out += [
                    {"record_id": ids[rec], "child": p.node.child, "entry": e, "parent_entry": pe, "parent_key": pk, "child_key": k, "fields": [(n, _text(v)) for n, v in f.items()]}
                    for p in stripes.places for rec, e, pe, pk, k, f in stripes.table(p)
                ]
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return rows.mapInArrow(run, CHILD_SCHEMA)


_ARROW = pa.schema([
    ("record_id", pa.int64()), ("child", pa.string()), ("entry", pa.int32()), ("parent_entry", pa.int32()), ("parent_key", pa.string()),
    ("child_key", pa.string()), ("fields", pa.map_(pa.string(), pa.string())),
])
