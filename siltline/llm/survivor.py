"""The best representative of each duplicate group, by token-level consensus."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltline.operators.arrow import differs_from_previous, joined
from siltline.operators.runs import ROW_GROUP, Run, RunFile, partitions, run_folder

#: Distinct values up to which a group is aligned in one piece; the values of larger groups are streamed.
GROUP_VALUES = 256
#: Table cells up to which a sequence is aligned by one table; above, in parts that take linear space, as exactly.
ALIGN_CELLS = 1_000_000

_TOKEN = re.compile(r"\w+|[^\w\s]")
#: The only token of a missing value. No text has it, since a token is a word or one visible sign.
_MISSING = " "


def tokens(value: str | None) -> list[str]:
    """Words and single signs of a value; a missing value is one token of its own."""
    return [_MISSING] if value is None else _TOKEN.findall(value)


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int | None, int | None]]:
    """A cheapest alignment of two token sequences, as pairs of places; None is a gap."""
    return fit([(t,) for t in a], b)


def distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Tokens to insert, remove or replace."""
    return sum(i is None or j is None or a[i] != b[j] for i, j in align(a, b))


Columns = Sequence[Collection[str | None]]


def fit(columns: Columns, value: Sequence[str]) -> list[tuple[int | None, int | None]]:
    """A cheapest alignment of a token sequence to columns, as pairs of places; None is a gap.

    A token costs nothing in a column that holds it, 1 in another and 1 without a column; leaving a column
    out costs 1, or nothing if the column holds a gap (None). Of equally cheap ones it is one that pairs the common
    beginning, then the common end.
    """
    n, m = len(columns), len(value)
    lo = 0
    while lo < min(n, m) and value[lo] in columns[lo] and None not in columns[lo]:
        lo += 1
    hi = 0
    while hi < min(n, m) - lo and value[-1 - hi] in columns[-1 - hi] and None not in columns[-1 - hi]:
        hi += 1
    middle = _cheapest(columns[lo : n - hi], value[lo : m - hi], lo, lo, ALIGN_CELLS)
    return [(i, i) for i in range(lo)] + middle + [(n - hi + i, m - hi + i) for i in range(hi)]


def _cheapest(columns: Columns, value: Sequence[str], i0: int, j0: int, cells: int) -> list[tuple[int | None, int | None]]:
    """By one table, or above ``cells`` in two parts, cut where the costs of both add up to the least (Hirschberg)."""
    n, m = len(columns), len(value)
    if n > 1 and n * m > cells:
        half = n // 2
        j = int(np.argmin(_costs(columns[:half], value) + _costs(columns[half:][::-1], value[::-1])[::-1]))
        least = min(cells, ALIGN_CELLS // 64)
        return _cheapest(columns[:half], value[:j], i0, j0, least) + _cheapest(columns[half:], value[j:], i0 + half, j0 + j, least)
    table = [list(range(m + 1))]
    for c in columns:
        above, skip = table[-1], None not in c
        row = [above[0] + skip]
        for j, y in enumerate(value, 1):
            row.append(min(above[j - 1] + (y not in c), above[j] + skip, row[j - 1] + 1))
        table.append(row)
    out, i, j = [], n, m
    while i or j:
        if i and j and table[i][j] == table[i - 1][j - 1] + (value[j - 1] not in columns[i - 1]):
            i, j = i - 1, j - 1
            out.append((i0 + i, j0 + j))
        elif i and table[i][j] == table[i - 1][j] + (None not in columns[i - 1]):
            i -= 1
            out.append((i0 + i, None))
        else:
            j -= 1
            out.append((None, j0 + j))
    return out[::-1]


def _costs(columns: Columns, value: Sequence[str]) -> np.ndarray:
    """The least cost of all columns with each beginning of the value."""
    found: dict[str, list[int]] = {}
    for j, t in enumerate(value):
        found.setdefault(t, []).append(j)
    at = {t: np.array(js) for t, js in found.items()}
    place = np.arange(len(value) + 1)
    row = place
    for c in columns:
        beside = row[:-1] + 1
        for t in c if len(c) <= len(at) else at:
            if t in c and t in at:
                beside[at[t]] -= 1
        below = row + (None not in c)
        below[1:] = np.minimum(below[1:], beside)
        row = np.minimum.accumulate(below - place) + place
    return row


class Profile:
    """Votes of the values aligned so far: per column the weight of each token, and of the gap (None)."""

    __slots__ = ("columns", "values", "voted")

    def __init__(self) -> None:
        self.columns: list[dict[str | None, float]] = []
        self.values, self.voted = 0, 0

    def add(self, value: Sequence[str], weight: float) -> None:
        """Aligns a value to all columns, those won by a gap too, so that votes for one inserted token add up."""
        merged: list[dict[str | None, float]] = []
        for i, j in fit(self.columns, value):
            c = self.columns[i] if i is not None else {None: self.voted} if self.values else {}
            t = None if j is None else value[j]
            c[t] = c.get(t, 0) + weight
            merged.append(c)
        self.columns = merged
        self.values += 1
        self.voted += weight

    def consensus(self, weighted: bool = True) -> list[str]:
        """The winners; of equal votes, and without weights, the one that voted first."""
        winners = (max(c, key=c.__getitem__) if weighted else next(iter(c)) for c in self.columns)
        return [t for t in winners if t is not None]


def consensus(values: Sequence[Sequence[str]], weights: Sequence[float] | None) -> list[str]:
    """Progressive alignment in the given order: each value is aligned to the profile of those before and votes per column."""
    profile = Profile()
    for n, value in enumerate(values):
        profile.add(value, 0 if weights is None else weights[n])
    return profile.consensus(weights is not None)


def closest(values: Sequence[str | None], weights: Sequence[float] | None) -> int:
    """Place of the value closest to the consensus of all; of equally close ones the first.

    Without weights the order is one of trust: each value outweighs all behind it together, so that a column's
    first vote decides it.
    """
    if len(values) == 1:
        return 0
    split = [tokens(v) for v in values]
    agreed = consensus(split, weights)
    return min(range(len(values)), key=lambda i: distance(split[i], agreed))


def _rank(rows: DataFrame, by: Sequence[tuple[str, str]]) -> Column:
    """A struct that is least for the most trusted row."""
    parts: list[Column] = []
    for n, (name, direction) in enumerate(by):
        kind = rows.schema[name].dataType
        c = F.unix_micros(F.col(name)) if isinstance(kind, T.TimestampType) else F.col(name)
        parts += [F.col(name).isNull().alias(f"n{n}"), (F.negative(c) if direction == "desc" else c).alias(f"r{n}")]
    return F.struct(*parts)


def _ranked(rows: DataFrame, n: int, name: str, direction: str) -> Column:
    """The value that a place of the rank was made of."""
    kind = rows.schema[name].dataType
    c = F.col(f"best.r{n}")
    c = F.negative(c) if direction == "desc" else c
    return (F.timestamp_micros(c) if isinstance(kind, T.TimestampType) else c).cast(kind).alias(name)


def most_trusted(rows: DataFrame, keys: Sequence[str], by: Sequence[tuple[str, str]], value: str | None = None) -> DataFrame:
    """The most trusted observation for each group of ``keys``, by the order ``by`` alone.

    This is what ``closest`` returns without weights, whatever the values are, so nothing is aligned. One aggregate, on the map
    side first, so a group of many rows meets only as its least row of each task.

    Returns the keys, the columns of ``by`` and, if given, ``value``. Null is a key like any other; in ``by`` nulls
    come last; rows that ``by`` leaves equal are told apart by ``value``, null first; no rows, no result.
    """
    keys = list(keys)
    k = [f"k{i}" for i in range(len(keys))]
    values = [] if value is None else [F.col(value).alias("value")]
    base = rows.select(*(F.col(c).alias(a) for a, c in zip(k, keys)), F.struct(_rank(rows, by).alias("best"), *values).alias("row"))
    found = base.groupBy(*k).agg(F.min("row").alias("row")).select(*k, "row.*")
    return found.select(*(F.col(a).alias(c) for a, c in zip(k, keys)), *(_ranked(rows, n, c, direction) for n, (c, direction) in enumerate(by)), *(F.col("value").alias(value) for _ in values))


def consensus_survivors(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    by: Sequence[tuple[str, str]],
    weight: str | None = None,
    group_values: int = GROUP_VALUES,
) -> DataFrame:
    """One surviving observation for each group of ``keys``: that of the existing value closest to the consensus.

    The values of a group are aligned token by token in order of trust (``by``), tokens vote per column, and
    the winners are the consensus. With a ``weight`` column a value's vote is the sum of its rows' weights:
    the value that most evidence agrees on survives. Without one the votes are lexicographic, each value
    outweighs all less trusted ones together: the value backed by the most trusted observation survives, and
    as no alignment can change that, none is made (``most_trusted``).
    Of the rows that hold the surviving value, the most trusted one is returned.

    Rows are first reduced to distinct values (on the map side too), which are sorted by trust and stream by.
    A group of up to ``group_values`` distinct values is settled at its end. Of a larger one, only the votes are
    kept; its values go to a file in the folder that all executors share, and their distances to the consensus
    are taken by many tasks, one per row group of that file. ``group_values`` thus decides where a group waits,
    never the result. The alignment of one group is sequential, and its votes are as many as its distinct tokens
    per column. All is one plan with one scan.

    Returns the keys, the columns of ``by`` and ``value``.

    Defined cases: a null value is a value of its own; null is a key like any other; in ``by`` nulls come
    last; a null weight counts 0; empty text has no tokens; ties fall to the more trusted row; repeated rows
    add their weight and change nothing without weights; other columns do not matter; no rows, no result.
    """
    if weight is None:
        return most_trusted(rows, keys, by, value)
    keys = list(keys)
    k = [f"k{i}" for i in range(len(keys))]
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    base = rows.select(*(F.col(c).alias(a) for a, c in zip(k, keys)), F.col(value).alias("value"), _rank(rows, by).alias("best"), w.alias("w"))
    distinct = base.groupBy(*k, "value").agg(F.min("best").alias("best"), F.sum("w").alias("w"))
    settled = _settled(distinct, k, group_values, run_folder(rows.sparkSession))
    found = _nearest(settled, k, partitions(rows.sparkSession))
    return found.select(*(F.col(a).alias(c) for a, c in zip(k, keys)), *(_ranked(rows, n, c, direction) for n, (c, direction) in enumerate(by)), F.col("value").alias(value))


class _Large:
    """A group whose values wait in a file while its votes are counted."""

    def __init__(self, folder: str, k: list[str]) -> None:
        self.k, self.file, self.profile, self.last = k, RunFile(folder, 0, 0, (), ROW_GROUP // 16), Profile(), None

    def add(self, rows: pa.Table) -> None:
        for v, w in zip(rows.column("value").to_pylist(), rows.column("w").to_pylist()):
            self.profile.add(tokens(v), w)
        self.file.add(rows.select([*self.k, "best", "value"]))
        self.last = rows.slice(rows.num_rows - 1)

    def closed(self, schema: pa.Schema) -> pa.RecordBatch:
        """What is left to do: one row that names the file, its parts and the consensus."""
        stored = self.file.close()
        open_ = {"path": pa.array([stored["path"]]), "parts": pa.array([len(self.file.marks)], pa.int32()), "agreed": pa.array([self.profile.consensus()], pa.list_(pa.string()))}
        return _row_batch(self.last, schema, open_)


def _row_batch(rows: pa.Table, schema: pa.Schema, more: dict[str, pa.Array]) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    columns = [more[f.name] if f.name in more else rows.column(f.name).combine_chunks() if f.name in rows.column_names else pa.nulls(rows.num_rows, f.type) for f in schema]
    return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema)


def _settled(distinct: DataFrame, k: list[str], group_values: int, folder: str) -> DataFrame:
    """Per group the survivor, or where its values lie and what they agreed on."""
    kinds = distinct.schema
    out = T.StructType([*(kinds[c] for c in k), T.StructField("best", kinds["best"].dataType), T.StructField("value", T.StringType()), T.StructField("path", T.StringType()), T.StructField("parts", T.IntegerType()), T.StructField("agreed", T.ArrayType(T.StringType()))])
    ordered = distinct.repartition(*k).sortWithinPartitions(*k, "best", "value")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows of a group that may go on
        large: _Large | None = None
        schema: pa.Schema | None = None

        def small(table: pa.Table, edges: list[int]) -> Iterator[pa.RecordBatch]:
            values, weights, chosen = table.column("value").to_pylist(), table.column("w").to_pylist(), []
            for lo, hi in zip(edges, edges[1:]):
                if hi - lo > group_values:
                    group = _Large(folder, k)
                    group.add(table.slice(lo, hi - lo))
                    yield group.closed(schema)
                else:
                    chosen.append(lo + closest(values[lo:hi], weights[lo:hi]))
            if chosen:
                yield _row_batch(table.take(pa.array(chosen)), schema, {})

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            schema = schema or pa.schema([*(table.schema.field(c) for c in [*k, "best", "value"]), ("path", pa.string()), ("parts", pa.int32()), ("agreed", pa.list_(pa.string()))])
            if large is not None:
                new = np.flatnonzero(differs_from_previous(joined(large.last, batch), k))
                end = int(new[0]) if len(new) else table.num_rows
                if end:
                    large.add(table.slice(0, end))
                if end == table.num_rows:
                    continue
                yield large.closed(schema)
                large, table = None, table.slice(end)
            elif held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            edges = [0, *(np.flatnonzero(differs_from_previous(table, k)) + 1).tolist()]
            yield from small(table.slice(0, edges[-1]), edges)
            held = table.slice(edges[-1])
            if held.num_rows > group_values:
                large, held = _Large(folder, k), None
                large.add(table.slice(edges[-1]))
        if large is not None:
            yield large.closed(schema)
        elif held is not None:
            yield from small(held, [0, held.num_rows])

    return ordered.mapInArrow(stream, out)


def _nearest(settled: DataFrame, k: list[str], number: int) -> DataFrame:
    """The settled groups as they are, and of each other one the value closest to what was agreed, its file read in parts by many tasks."""
    kinds = settled.schema
    out = T.StructType([*(kinds[c] for c in k), kinds["best"], kinds["value"], T.StructField("far", T.IntegerType())])
    parts = settled.withColumn("part", F.explode_outer(F.when(F.col("path").isNotNull(), F.sequence(F.lit(0), F.col("parts") - 1))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(c) for c in [*k, "best", "value"]), ("far", pa.int32())])
            done = pa.Table.from_batches([batch.filter(batch.column("path").is_null())])
            if done.num_rows:
                yield _row_batch(done, schema, {"far": pa.array(np.zeros(done.num_rows, np.int32))})
            for row in batch.select(["path", "part", "agreed"]).filter(batch.column("path").is_valid()).to_pylist():
                rows = Run(row["path"], [], ()).group(row["part"])
                far = [distance(tokens(v), row["agreed"]) for v in rows.column("value").to_pylist()]
                first = min(range(len(far)), key=far.__getitem__)  # the rows are in order of trust
                yield _row_batch(rows.slice(first, 1), schema, {"far": pa.array([far[first]], pa.int32())})

    scored = parts.repartition(number, *k, "part").mapInArrow(score, out)
    return scored.groupBy(*k).agg(F.min(F.struct("far", "best", "value")).alias("f")).select(*k, "f.best", "f.value")
