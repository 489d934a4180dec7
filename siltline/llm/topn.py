"""Top N items of every group, by merging sorted runs with a loser tree."""

from __future__ import annotations

import operator
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltline.operators.arrow import differs_from_previous, in_batches, joined
from siltline.operators.runs import ROW_GROUP, RUNS, Run, items_of, key_at, merge_ranges, partitions, run_folder, spread_by_run, write_runs
from siltline.operators.skew import key_hash


class LoserTree:
    """Merges sorted iterators: every inner node keeps the loser of its match, the root's winner is the least head.

    Equal heads come in the order of the iterators.
    """

    def __init__(self, runs: Iterable[Iterable[tuple]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.n = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, self.n)
        self.winner = self._build(1) if self.n else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _build(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if not self._beats(a, b):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        while self.n and (head := self.heads[self.winner]) is not None:
            yield head
            now = self.winner
            self.heads[now] = next(self.runs[now], None)
            node = (now + self.n) // 2
            while node:
                if self._beats(self.losers[node], now):
                    now, self.losers[node] = self.losers[node], now
                node //= 2
            self.winner = now


class Cursor:
    """A place in a stored run that is sorted by group and, inside, by rank. Only the row group it stands in is in memory."""

    def __init__(self, run: Run, g: Sequence[str], ordered: Callable[[object], object]) -> None:
        self.run, self.g, self.ordered = run, g, ordered
        self.load(0)

    def load(self, i: int) -> None:
        self.i, self.at, self.keys = i, 0, []
        if i >= len(self.run.marks):
            return
        table = self.run.group(i)
        edges = [0, *(np.flatnonzero(differs_from_previous(table, self.g)) + 1).tolist()]
        self.keys = [key_at(table, e, self.g) for e in edges]
        self.spans = list(zip(edges, [*edges[1:], table.num_rows]))
        self.score, self.item = table.column("score").to_pylist(), table.column("item").to_pylist()
        self.table = table

    @property
    def group(self) -> tuple | None:
        return self.keys[self.at] if self.at < len(self.keys) else None

    def names(self) -> tuple:
        """The group's values."""
        return tuple(self.table.column(c)[self.spans[self.at][0]].as_py() for c in self.g)

    def rows(self) -> Iterator[tuple]:
        """The rest of the present group as (order, item, score), read on across row groups."""
        group = self.group
        while self.group == group:
            for i in range(*self.spans[self.at]):
                yield self.ordered(self.score[i]), self.item[i], self.score[i]
            self.at += 1
            if self.at == len(self.keys):
                self.load(self.i + 1)

    def seek(self, group: tuple) -> None:
        """To the first group behind this one. Row groups that hold nothing else are left out unread."""
        while self.i < len(self.run.marks):
            self.at = bisect_right(self.keys, group, self.at)
            if self.at < len(self.keys):
                return
            behind = bisect_right(self.run.marks, group, self.i + 1)  # the first row group that begins with another group
            self.load(max(self.i + 1, behind - 1))


def merge_runs(cursors: Sequence[Cursor], n: int) -> Iterator[tuple[tuple, object, object, int]]:
    """The first ``n`` distinct items of each group, as (group, score, item, place), by a multiway merge of the runs."""
    waiting = [(c.group, i) for i, c in enumerate(cursors) if c.group is not None]
    heapify(waiting)
    while waiting:
        group, own = waiting[0][0], []
        while waiting and waiting[0][0] == group:
            own.append(heappop(waiting)[1])
        names, seen = cursors[own[0]].names(), set()
        for _, item, score in LoserTree([cursors[i].rows() for i in own]):
            if item not in seen:
                seen.add(item)
                yield names, score, item, len(seen)
                if len(seen) == n:
                    break
        for i in own:
            cursors[i].seek(group)
            if cursors[i].group is not None:
                heappush(waiting, (cursors[i].group, i))


def top_n(rows: DataFrame, group: Sequence[str], score: str, item: str, n: int, distinct: bool = False, row_group: int = ROW_GROUP) -> DataFrame:
    """The ``n`` distinct items of the highest score in every group; equal scores by item ascending.

    Copies of an item are merged first (``distinct`` says that there are none). Every partition is sorted by
    group, score and item and read in one pass that, after ``n`` items of a group, goes on to the next group; so
    a group of millions of items is cut where it lies. What is left of the partitions is stored as bucketed runs, at
    most ``RUNS`` per bucket of the group, each ordered by group, score and item. Per bucket, a loser tree merges the
    runs' heads; after ``n`` items every run seeks to its next group, past row groups that it need not read. All
    is one plan. Text is ordered by code point.

    Returns the group, ``score``, ``item`` and ``place`` (from 1).

    Defined cases: rows whose score or item is null, or whose score is not a number, take no part; null is a group like any other; an item
    that occurs more than once in a group counts once, with its highest score; groups of fewer than ``n``
    items give what they have; other columns do not matter; an empty table gives no rows.
    """
    spark, g = rows.sparkSession, [f"g{i}" for i in range(len(group))]
    base = rows.filter(F.col(score).isNotNull() & F.col(item).isNotNull()).select(*(F.col(c).alias(a) for a, c in zip(g, group)), F.col(score).alias("score"), F.col(item).alias("item"))
    if isinstance(base.schema["score"].dataType, (T.DoubleType, T.FloatType)):
        base = base.filter(~F.isnan("score"))
    if not distinct:
        base = base.groupBy(*g, "item").agg(F.max("score").alias("score")).select(*g, "score", "item")
    order = [*(F.col(a).asc_nulls_first() for a in g), F.col("score").desc(), F.col("item").asc()]
    heads = T.StructType([*(T.StructField(a, base.schema[a].dataType) for a in g), T.StructField("score", base.schema["score"].dataType), T.StructField("item", base.schema["item"].dataType)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """At most n rows of each group of a sorted partition."""
        last, taken = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = joined(last, batch)
            new = differs_from_previous(table, g)
            new = np.append(True, new) if last is None else new
            at = np.arange(len(new))
            start = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(start < 0, at + taken, at - start)
            kept = (table if last is None else table.slice(1)).filter(pa.array(place < n))
            taken, last = int(place[-1]) + 1, table.slice(table.num_rows - 1)
            yield from in_batches(kept)

    number = partitions(spark)
    cuts = base.sortWithinPartitions(*order).mapInArrow(cut, heads)
    placed = cuts.withColumns({"bucket": F.pmod(key_hash(g), F.lit(number)), "run": F.pmod(F.spark_partition_id(), F.lit(RUNS)).cast("bigint")})
    manifest = write_runs(spread_by_run(placed, number, order), run_folder(spark), g, row_group=row_group)
    final = T.StructType([*heads.fields, T.StructField("place", T.IntegerType())])
    ordered = operator.neg if isinstance(base.schema["score"].dataType, T.NumericType) else _Descending

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files, _, _ in items_of(batches):
            cursors = [Cursor(Run(path, marks, g), g, ordered) for path, marks in files]
            kinds = pa.schema([*((f.name, f.type) for f in cursors[0].run.file.schema_arrow), ("place", pa.int32())])
            found = merge_runs(cursors, n)
            while part := list(islice(found, 10_000)):
                names, *rest = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array(column, kind.type) for column, kind in zip([*zip(*names), *rest], (kinds.field(c) for c in final.names))], names=final.names)

    out = merge_ranges(manifest, number, 1 << 62).mapInArrow(merged, final)
    return out.select(*(F.col(a).alias(c) for a, c in zip(g, group)), F.col("score").alias(score), F.col("item").alias(item), "place")


class _Descending:
    """Orders its values from high to low."""

    __slots__ = ("value",)

    def __init__(self, value: object) -> None:
        self.value = value

    def __lt__(self, other: _Descending) -> bool:
        return other.value < self.value

    def __eq__(self, other: object) -> bool:
        return self.value == other.value
