"""Columnar shredding of deeply nested JSON records, and flat tables put together from the level sequences."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltline.functions.json_text import depth_bound, read_json, write_json
from siltline.operators.history import read_object

#: Members of a record that hold objects, those that are keyed by a name first, and members of such objects.
ROOTS = ("formats", "chapters", "thumbnails", "subtitles", "comments", "entries")
KEYED = ("subtitles",)
NESTED = ("formats", "chapters", "fragments", "replies")
#: Records that are shredded at a time; bounds the memory of a task.
STRIPE = 400
#: Calls per level of nesting while a record is read, and levels that need no look at how deep a record is.
CALLS, LEVELS = 6, 3_000

#: Slots of a column up to which they are gone through one by one.
FEW_SLOTS = 64

Path = tuple[str, ...]


class Node:
    """An object: its other members, and per nested member the slots (key, Node or None)."""

    __slots__ = ("groups", "values")

    def __init__(self, values: dict, groups: dict[str, list]) -> None:
        self.values, self.groups = values, groups


def _unwrapped(value: object) -> object:
    """A list or object that was delivered as JSON text, however often encoded, is read; other text holds nothing."""
    while isinstance(value, str):  # each reading takes at least the quotes off, so this ends
        try:
            value = read_json(value)
        except ValueError:
            return None
    return value


def _slots(value: object, nested: frozenset[str], keyed: bool, seen: dict[Path, None], path: Path) -> list:
    """The slots of a member in order, each ((key or positions), Node or None)."""
    value = _unwrapped(value)
    if keyed and isinstance(value, dict) and all(v is None or isinstance(_unwrapped(v), (dict, list)) for v in value.values()):
        return [(name, _slots(v, nested, False, seen, path)) for name, v in value.items()]
    if isinstance(value, dict):
        value = [value]
    if not isinstance(value, list):
        return []
    out: list = []
    for x in value:
        x = _unwrapped(x)
        out.append(_node(x, nested, seen, path) if isinstance(x, dict) else None)
    return [("", out)] if keyed else out


def _deep(value: object, most: int) -> bool:
    """Is a value nested deeper than so many levels? Text that may hold JSON counts by its brackets."""
    level, deep = [value], 0
    while level and deep <= most:
        level = [inner for x in level if isinstance(x, (dict, list)) for inner in (x.values() if isinstance(x, dict) else x)]
        deep += 1
        if any(isinstance(x, str) and depth_bound(x) > most - deep for x in level):
            return True
    return bool(level)


def _node(value: dict, members: frozenset[str], seen: dict[Path, None], path: Path, keyed: frozenset[str] = frozenset(), nested: frozenset[str] | None = None) -> Node:
    inner = members if nested is None else nested
    values, groups = {}, {}
    for name, v in value.items():
        if name in members:
            at = (*path, name)
            groups[name] = _slots(v, inner, name in keyed, seen, at)
            seen[at] = None
        else:
            values[name] = v
    return Node(values, groups)


class Leaf:
    """One leaf path: a repetition and a definition level per slot of its group, and the values there are.

    A leaf is not repeated inside its group, so its repetition levels are those of the group, which all leaves of
    the group share in memory. Its definition levels are its own: one above the group's where the member is there.
    """

    __slots__ = ("defs", "max_def", "reps", "values")

    def __init__(self, group: Column, slots: Sequence[int], values: list) -> None:
        self.reps, self.max_def, self.values = group.reps, group.max_def + 1, values
        self.defs = np.array(group.defs, np.int32)
        self.defs[list(slots)] += 1


class Column:
    """One repeated group: repetition and definition level of each slot, its record, key, and its leaf paths.

    Levels count per nesting step one repetition (two for a keyed member: key and place) and two
    definitions: that there is a slot, and that it holds an object. A leaf has one more, that the member is there.
    """

    __slots__ = ("defs", "keys", "leaves", "max_def", "records", "reps")

    def __init__(self, max_def: int) -> None:
        self.max_def, self.reps, self.defs, self.records, self.keys, self.leaves = max_def, [], [], [], [], {}

    def put(self, record: int, rep: int, level: int, key: str | None = None, values: Mapping | None = None) -> None:
        at = len(self.reps)
        self.reps.append(rep)
        self.defs.append(level)
        self.records.append(record)
        self.keys.append(key)
        for name, v in (values or {}).items():
            slots, found = self.leaves.setdefault(name, ([], []))
            slots.append(at)
            found.append(v)


    def leaf(self, name: str) -> Leaf:
        return Leaf(self, *self.leaves[name])


def shred(records: Sequence[str | None], roots: Sequence[str] = ROOTS, keyed: Sequence[str] = KEYED, nested: Sequence[str] = NESTED) -> dict[Path, Column]:
    """The columns of a stripe of JSON texts, by path of the repeated group. Texts that are no object have none."""
    top, inner, maps = frozenset(roots), frozenset(nested), frozenset(keyed)
    seen: dict[Path, None] = {}
    trees: list[Node | None] = []
    for text in records:
        found = read_object(text)
        if found is not None and (levels := depth_bound(text)) * CALLS > sys.getrecursionlimit() and _deep(found, sys.getrecursionlimit() // CALLS):
            # Calls between functions written in Python take no room on the machine's stack.
            sys.setrecursionlimit(levels * CALLS + 1_000)
        trees.append(None if found is None else _node(found, top, seen, (), maps, inner))
    children: dict[Path, list[Path]] = {}
    for path in seen:  # the groups above a group are members too
        children.setdefault(path[:-1], []).append(path)
    columns = {path: Column(2 * len(path)) for below in children.values() for path in below}

    def missing(path: Path, record: int, rep: int, level: int) -> None:
        columns[path].put(record, rep, level)
        for below in children.get(path, ()):
            missing(below, record, rep, level)

    def write(parent: Node | None, path: Path, record: int, rep: int, level: int, deep: int) -> None:
        """All groups below an object (or below a null slot). deep: repetition level of the object."""
        for at in children.get(path, ()):
            slots = parent.groups.get(at[-1]) if parent is not None else None
            if not slots:
                missing(at, record, rep, level)
            elif at[-1] in maps and len(at) == 1:
                first = rep
                for key, places in slots:
                    if not places:
                        missing(at, record, first, level)
                    for i, node in enumerate(places):
                        slot(node, at, record, first if i == 0 else deep + 2, level, deep + 2, key)
                    first = deep + 1
            else:
                for i, node in enumerate(slots):
                    slot(node, at, record, rep if i == 0 else deep + 1, level, deep + 1, None)

    def slot(node: Node | None, at: Path, record: int, rep: int, level: int, deep: int, key: str | None) -> None:
        columns[at].put(record, rep, level + (1 if node is None else 2), key, None if node is None else node.values)
        write(node, at, record, rep, level + (1 if node is None else 2), deep)

    for record, tree in enumerate(trees):
        if tree is not None:
            write(tree, (), record, 0, 0, 0)
    return columns


def places(column: Column, depth: int, maps: bool) -> tuple[np.ndarray, list[str]]:
    """Which slots hold an object, and the places of these from the outside in, from the level sequences alone."""
    reps, defs = np.asarray(column.reps, np.int32), np.asarray(column.defs, np.int32)
    held = np.flatnonzero(defs == column.max_def)
    counts = _few_counts(column, depth + maps) if len(reps) < FEW_SLOTS else _counts(reps, held, depth + maps)
    if maps:  # the key stands for the place at the first level
        keys = [column.keys[i] for i in held.tolist()]
        rest = [c.tolist() for c in counts[1:]]
        return held, [".".join(([key] if key else []) + list(map(str, at))) for key, *at in zip(keys, *rest)]
    return held, [".".join(map(str, at)) for at in zip(*(c.tolist() for c in counts))]


def _counts(reps: np.ndarray, held: np.ndarray, levels: int) -> list[np.ndarray]:
    """Per level the places of the held slots: how often it repeated since a level above did."""
    index, out = np.arange(len(reps)), []
    for level in range(1, levels + 1):
        steps = np.cumsum(reps == level)
        start = np.maximum.accumulate(np.where(reps < level, index, 0))
        out.append((steps - steps[start])[held])
    return out


def _few_counts(column: Column, levels: int) -> list[np.ndarray]:
    """The same slot by slot, which is quicker where there are few slots, however deep."""
    place, out = np.zeros(levels, np.int64), []
    for rep, level in zip(column.reps, column.defs):
        if rep:
            place[rep - 1] += 1
        place[rep:] = 0
        if level == column.max_def:
            out.append(place.copy())
    return list(np.array(out, np.int64).reshape(-1, levels).T)


def _text(value: object) -> str | None:
    if value is None:
        return None
    text = value if isinstance(value, str) else write_json(value)
    return text.encode("utf-8", "backslashreplace").decode()


def nested_rows(
    records: DataFrame,
    ids: Sequence[str],
    raw: str,
    roots: Sequence[str] = ROOTS,
    keyed: Sequence[str] = KEYED,
    nested: Sequence[str] = NESTED,
    attributes: bool = True,
) -> DataFrame:
    """One flat row per object that a record holds in ``roots`` and, inside these, in ``nested``, at any depth.

    Each stripe of records is shredded into columns with a repetition and a definition level per leaf path; the
    rows of every repeated ancestor are then put together from the level sequences. Without ``attributes`` the
    leaves are pruned and the ancestors' own levels are enough. Nothing is shuffled.

    Returns the ids, ``member_path`` (member names), ``pos_path`` (places from the outside in; a ``keyed``
    member's key stands before the place), ``parent_path`` and ``parent_pos`` (both '' for the record
    itself), and, with ``attributes``, ``attributes``: the object's other members as a map of texts, values
    that are not text as JSON.

    Defined cases: a member may be a list, a single object (place 0), or either as JSON text, encoded any number of times; a null element
    keeps its place and is no row; other elements are treated like null; text that is not one complete JSON
    object has no rows; any depth is read; empty members have none; null ids are kept; clashing names of other columns do not
    matter; repeated records give repeated rows.
    """
    ids = list(ids)
    source = records.select(*(F.col(c).alias(f"i{n}") for n, c in enumerate(ids)), F.col(raw).alias("raw"))
    names = [f"i{n}" for n in range(len(ids))]
    extra = [T.StructField("attributes", T.MapType(T.StringType(), T.StringType()))] if attributes else []
    schema = T.StructType([*(T.StructField(c, source.schema[c].dataType) for c in names), *(T.StructField(c, T.StringType()) for c in ("member_path", "pos_path", "parent_path", "parent_pos")), *extra])
    maps = frozenset(keyed)

    def tables(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = shred(batch.column("raw").to_pylist(), roots, keyed, nested)
        for path, column in columns.items():
            keyed_path = path[0] in maps
            if keyed_path and len(path) > 1:
                column.keys = _inherited(columns[path[:1]], column)
            held, at = places(column, len(path), keyed_path)
            if not len(held):
                continue
            rows = batch.take(pa.array(np.asarray(column.records, np.int64)[held]))
            n = len(held)
            up = [x.rpartition(".")[0] for x in at] if len(path) > 1 else [""] * n
            out = [*(rows.column(c) for c in names), pa.array([".".join(path)] * n), pa.array(at, pa.string()), pa.array([".".join(path[:-1])] * n), pa.array(up, pa.string())]
            if attributes:
                out.append(_attributes(column, held))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), LEVELS * CALLS))
        for batch in batches:
            for lo in range(0, batch.num_rows, STRIPE):
                yield from tables(batch.slice(lo, STRIPE))

    return source.mapInArrow(stream, schema).select(*(F.col(a).alias(c) for a, c in zip(names, ids)), *schema.names[len(ids) :])


def _inherited(root: Column, column: Column) -> list[str | None]:
    """Keys of the outermost slots for the slots of a deeper group: both start a slot anew where rep <= 2."""
    starts = iter(root.keys)
    out: list[str | None] = []
    key = None
    for rep in column.reps:
        if rep <= 2:
            key = next(starts)
        out.append(key)
    return out


def _attributes(column: Column, held: np.ndarray) -> pa.Array:
    """The leaf columns put together to one map per slot that holds an object, by the definition levels."""
    row = np.full(len(column.reps), -1)
    row[held] = np.arange(len(held))
    maps: list[list[tuple[str, str | None]]] = [[] for _ in held]
    for name in column.leaves:
        leaf = column.leaf(name)
        there = np.flatnonzero(leaf.defs == leaf.max_def)
        for r, v in zip(row[there].tolist(), leaf.values):
            maps[r].append((_text(name), _text(v)))
    return pa.array(maps, pa.map_(pa.string(), pa.string()))


def flat_table(rows: DataFrame, ids: Sequence[str], member_path: str, columns: Mapping[str, str]) -> DataFrame:
    """The table of one member path: ids, places, and the given attributes with the given types.

    A value that does not fit its type is null.
    """
    return rows.filter(F.col("member_path") == member_path).select(*ids, "pos_path", "parent_pos", *(F.col("attributes")[name].try_cast(kind).alias(name) for name, kind in columns.items()))
