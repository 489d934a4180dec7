"""What changed between full snapshots, by subtracting invertible Bloom lookup tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltline.operators.arrow import differs_from_previous, joined
from siltline.operators.skew import key_hash

#: Keys that a hash bucket is meant to hold.
BUCKET_ROWS = 20_000
#: Snapshots that are compared in one pass; each is a column of the rows that are added up.
WINDOW = 64
#: Cells of a first table per row of the larger snapshot, and how often it is enlarged fourfold.
FIRST_CELLS, ENLARGE = 0.4, 6
_HASHES = 3
#: Odd multipliers of the finalising hash (fixed values).
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mixing function, another one for each salt."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class LookupTable:
    """An invertible Bloom lookup table of (key hash, payload hash) pairs.

    A cell holds a count and the wrapping sums of key hash, payload hash and digest of the pairs that fall
    into it. Tables of one size can be subtracted; equal pairs then vanish and the others can be peeled.
    """

    def __init__(self, cells: int) -> None:
        self.part = max(8, -(-cells // _HASHES))
        self.count = np.zeros(self.part * _HASHES, np.int64)
        self.sums = np.zeros((3, self.part * _HASHES), np.uint64)

    def _at(self, digest: np.ndarray) -> list[np.ndarray]:
        return [(_mix(digest, j + 1) % np.uint64(self.part)).astype(np.int64) + j * self.part for j in range(_HASHES)]

    @staticmethod
    def digest(key: np.ndarray, payload: np.ndarray) -> np.ndarray:
        return _mix(key ^ _mix(payload, 11), 7)

    def add(self, key: np.ndarray, payload: np.ndarray, sign: int | np.ndarray = 1) -> None:
        digest = self.digest(key, payload)
        sign = np.broadcast_to(np.asarray(sign, np.int64), key.shape)
        for at in self._at(digest):
            np.add.at(self.count, at, sign)
            for row, x in zip(self.sums, (key, payload, digest)):
                np.add.at(row, at, x * sign.view(np.uint64) if sign.flags.c_contiguous else x * sign.astype(np.uint64))

    def minus(self, other: LookupTable) -> LookupTable:
        out = LookupTable.__new__(LookupTable)
        out.part, out.count, out.sums = self.part, self.count - other.count, self.sums - other.sums
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Keys, payloads and signs of all pairs in the table, or None if some cells stay full. It empties the table."""
        keys, payloads, signs = [], [], []
        while True:
            cells = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[cells].astype(np.uint64)
            key, payload, digest = (row[cells] * sign for row in self.sums)
            pure = self.digest(key, payload) == digest
            key, payload, digest, sign = key[pure], payload[pure], digest[pure], self.count[cells][pure]
            if not len(key):
                break
            _, first = np.unique(digest, return_index=True)
            key, payload, sign = key[first], payload[first], sign[first]
            self.add(key, payload, -sign)
            keys.append(key)
            payloads.append(payload)
            signs.append(sign)
        if self.count.any() or self.sums.any():
            return None
        none = np.zeros(0, np.uint64)
        return np.concatenate([none, *keys]), np.concatenate([none, *payloads]), np.concatenate([none.astype(np.int64), *signs])


def changed_hashes(old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray], first_cells: float = FIRST_CELLS, enlarge: int = ENLARGE) -> tuple[np.ndarray, np.ndarray]:
    """Key hashes only or differently in ``new``, and only or differently in ``old``; each side has a key once.

    A table that cannot be peeled is made anew four times as large. The digest of what was peeled must be
    the difference of the sides' digests; else, and after the last enlargement, the sides are compared
    directly, which is exact.
    """
    want = np.subtract(*(LookupTable.digest(*side).sum(dtype=np.uint64, keepdims=True) for side in (new, old)))[0]
    cells = int(first_cells * max(len(old[0]), len(new[0]), 1)) + 24
    for _ in range(enlarge):
        a, b = LookupTable(cells), LookupTable(cells)
        a.add(*new)
        b.add(*old)
        found = a.minus(b).peel()
        if found is not None:
            key, payload, sign = found
            if (LookupTable.digest(key, payload) * sign.astype(np.uint64)).sum(dtype=np.uint64) == want:
                return key[sign > 0], key[sign < 0]
        cells *= 4
    a, b = (np.rec.fromarrays([k, p]) for k, p in (new, old))
    return new[0][~np.isin(a, b)], old[0][~np.isin(b, a)]


def snapshot_changes(rows: DataFrame, snapshot: str, keys: Sequence[str], payload: Sequence[str] = (), snapshots: Sequence[int] | None = None, bucket_rows: int = BUCKET_ROWS, first_cells: float = FIRST_CELLS) -> DataFrame:
    """Keys added, removed or changed between each snapshot and the one before it.

    The rows are added up by key, on the map side first, to one row per key that holds the payload hash of each
    snapshot; so copies of a key, however many, go before anything is shuffled. A task cuts its rows, in order of
    the key hash, into buckets of ``bucket_rows``. Each bucket folds every snapshot into an invertible Bloom
    lookup table of (key hash, payload hash), subtracts neighbours, peels the pairs that differ, enlarges the
    table where that fails, verifies the digest, and classifies the recovered keys: in both sides is
    'changed', else 'added' or 'removed'. Keys of equal rows are never compared or even decoded.

    ``snapshots``: the numbers to compare, in order; by default all that occur, which takes a job of its own over
    that one column. Above ``WINDOW`` numbers, windows of them that overlap by one are compared one by one.
    Returns the snapshot number, the keys and ``change_kind``.

    Defined cases: null is a key value and a payload value like any other; a repeated key in a snapshot
    counts once, with the greatest payload hash where payloads differ (reduce them before, if another one
    should count); rows without a snapshot number belong to none and are left out; a snapshot that occurs
    but lacks a key removes it; other columns are ignored; an empty table has no changes. In a bucket where
    keys share a 64-bit hash, the columns are compared themselves.
    """
    keys, payload = list(keys), list(payload)
    k = [f"k{i}" for i in range(len(keys))]
    base = rows.select(F.col(snapshot).cast("long").alias("s"), *(F.col(c).alias(a) for a, c in zip(k, keys)), (key_hash(payload) if payload else F.lit(0).cast("long")).alias("p"))
    numbers = sorted(r["s"] for r in base.filter(F.col("s").isNotNull()).select("s").distinct().collect()) if snapshots is None else list(snapshots)
    windows = [numbers[at : at + WINDOW] for at in range(0, max(1, len(numbers) - 1), WINDOW - 1)]
    out = None
    for window in windows:
        part = _changes_between(base, k, window, bucket_rows, first_cells)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("s").cast(rows.schema[snapshot].dataType).alias(snapshot), *(F.col(a).alias(c) for a, c in zip(k, keys)), "change_kind")


def _changes_between(base: DataFrame, k: list[str], numbers: list[int], bucket_rows: int, first_cells: float) -> DataFrame:
    sides = [f"p{i}" for i in range(len(numbers))]
    held = [F.max(F.when(F.col("s") == n, F.col("p"))).alias(c) for n, c in zip(numbers, sides)]
    listed = base.filter(F.col("s").isin(numbers)) if numbers else base.filter(F.lit(False))
    wide = listed.groupBy(*k).agg(*held or [F.max("p").alias("_")]).withColumn("h", key_hash(k)).sortWithinPartitions("h")
    schema = T.StructType([T.StructField("s", T.LongType()), *(T.StructField(a, base.schema[a].dataType) for a in k), T.StructField("change_kind", T.StringType())])

    def bucket(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        signed = table.column("h").to_numpy()  # in ascending order
        h = signed.view(np.uint64)
        there = [table.column(c).is_valid().to_numpy(zero_copy_only=False) for c in sides]
        hashes = [table.column(c).fill_null(0).to_numpy().view(np.uint64) for c in sides]
        collides = bool((h[1:] == h[:-1]).any())
        for i, number in enumerate(numbers[1:]):
            old, new, p, q = there[i], there[i + 1], hashes[i], hashes[i + 1]
            if collides:
                kinds = {"added": new & ~old, "removed": old & ~new, "changed": old & new & (p != q)}
                found = {kind: np.flatnonzero(mask) for kind, mask in kinds.items()}
            else:
                came, went = changed_hashes((h[old], p[old]), (h[new], q[new]), first_cells)
                both = np.intersect1d(came, went)
                found = {kind: np.searchsorted(signed, x.view(np.int64)) for kind, x in (("added", np.setdiff1d(came, both)), ("removed", np.setdiff1d(went, both)), ("changed", both))}
            for kind, at in found.items():
                if len(at):
                    own = table.select(k).take(pa.array(at)).combine_chunks()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number)), *(own.column(a).chunk(0) for a in k), pa.array([kind] * len(at), pa.string())], names=schema.names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting = joined(waiting, batch)
            if waiting.num_rows < bucket_rows:
                continue
            edges = np.flatnonzero(differs_from_previous(waiting, ["h"])) + 1
            if len(edges):  # the last hash may go on in the next batch
                yield from bucket(waiting.slice(0, edges[-1]))
                waiting = waiting.slice(edges[-1])
        if waiting is not None:
            yield from bucket(waiting)

    return wide.mapInArrow(stream, schema)
