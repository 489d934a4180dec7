"""History of changing entity attributes, by merging co-partitioned, key-sorted snapshots."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltline.functions.json_text import read_json
from siltline.operators.arrow import differs_from_previous, in_batches, joined
from siltline.operators.runs import RANGE_ROWS, ROW_GROUP, RUNS, Run, first_not_below, items_of, key_at, merge_blocks, merge_ranges, partitions, run_folder, spread_by_run, write_runs
from siltline.operators.skew import key_hash

_DAY = 86_400_000_000


class Layout:
    """How snapshots are stored: by bucket of the entity, sorted by entity, time, order and payload."""

    def __init__(self, keys: Sequence[str], time: str, payload: Sequence[str], order: Sequence[str] = ()) -> None:
        self.names = (list(keys), time, list(payload), list(order))
        self.k, self.p, self.o = ([f"{letter}{i}" for i in range(len(names))] for letter, names in (("k", keys), ("p", payload), ("o", order)))
        self.sort = [*self.k, "t", *self.o, *self.p]

    def taken(self, rows: DataFrame) -> DataFrame:
        """The columns that count, under short names; rows without a time tell nothing."""
        keys, time, payload, order = self.names
        pairs = [*zip(keys, self.k), (time, "t"), *zip(payload, self.p), *zip(order, self.o)]
        return rows.filter(F.col(time).isNotNull()).select(*(F.col(c).alias(a) for c, a in pairs))

    def stored(self, rows: DataFrame, run: Column, folder: str, buckets: int, row_group: int = ROW_GROUP) -> DataFrame:
        """The manifest of taken rows, stored as runs: each snapshot sorted by itself, all cut into the same buckets."""
        placed = rows.withColumns({"bucket": F.pmod(key_hash(self.k), F.lit(buckets)), "run": run.cast("bigint")})
        return write_runs(spread_by_run(placed, buckets, self.sort), folder, self.sort, row_group=row_group)

    def versions(self, manifest: DataFrame, kinds: T.StructType, range_rows: int = RANGE_ROWS) -> DataFrame:
        """The merge of all runs that a manifest names."""
        keys, _, payload, _ = self.names
        moment = kinds["t"].dataType
        schema = T.StructType([*(T.StructField(c, kinds[c].dataType) for c in [*self.k, *self.p]), T.StructField("valid_from", moment), T.StructField("valid_to", moment)])
        sort, layout, names = self.sort, self, schema.names

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for files, lo, hi in items_of(batches):
                opened = [Run(path, marks, sort).since(lo) for path, marks in files]
                before = max((row for row, _ in opened if row is not None), key=lambda row: key_at(row, 0, sort), default=None)
                yield from layout.stream(merge_blocks((rest for _, rest in opened), sort), before, hi, names)

        out = merge_ranges(manifest, partitions(manifest.sparkSession), range_rows).mapInArrow(merge, schema)
        return out.select(*(F.col(a).alias(c) for a, c in zip(self.k, keys)), *(F.col(a).alias(c) for a, c in zip(self.p, payload)), "valid_from", "valid_to")

    def stream(self, blocks: Iterator[pa.Table], before: pa.Table | None, hi: tuple | None, names: list[str]) -> Iterator[pa.RecordBatch]:
        """Versions that start in a range of the merged rows. ``before``: the row before the range; ``hi``: where it ends.

        Behind the range it reads on only until the row that closes the last version.
        """
        last, open_ = before, None
        for block in blocks:
            inside, behind = block, None
            if hi is not None and key_at(block, block.num_rows - 1, self.sort) >= hi:
                n = first_not_below(block, hi, self.sort)
                inside, behind = block.slice(0, n), block.slice(n)
            if inside.num_rows:
                starts = self.changes(last, inside)
                last = inside.slice(inside.num_rows - 1)
                if starts.num_rows:
                    if open_ is not None:
                        starts = pa.concat_tables([open_, starts]).combine_chunks()
                    yield from self.closed(starts, False, names)
                    open_ = starts.slice(starts.num_rows - 1)
            if behind is not None and behind.num_rows:
                if open_ is None:
                    return
                if (closing := self.changes(last, behind).slice(0, 1)).num_rows:
                    yield from self.closed(pa.concat_tables([open_, closing]).combine_chunks(), False, names)
                    return
        if open_ is not None:
            yield from self.closed(open_, True, names)

    def changes(self, last: pa.Table | None, rows: pa.Table) -> pa.Table:
        """The rows whose entity or payload is not that of the row before."""
        if last is None:
            return rows.filter(pa.array(np.append(True, differs_from_previous(rows, [*self.k, *self.p]))))
        return rows.filter(pa.array(differs_from_previous(pa.concat_tables([last, rows]).combine_chunks(), [*self.k, *self.p])))

    def closed(self, starts: pa.Table, final: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
        """Versions with their ends; the last one only where nothing can follow."""
        other = differs_from_previous(starts, self.k)
        t = starts.column("t").combine_chunks()
        t = t.chunk(0) if isinstance(t, pa.ChunkedArray) else t
        ends = pa.concat_arrays([t.slice(1), pa.nulls(1, t.type)])
        ends = pc.if_else(pa.array(np.append(other, True)), pa.scalar(None, t.type), ends)
        table = starts.append_column("valid_to", ends).rename_columns([*("valid_from" if c == "t" else c for c in starts.column_names), "valid_to"])
        yield from in_batches(table.select(names).slice(0, starts.num_rows - (not final)))


def version_history(rows: DataFrame | Sequence[DataFrame], keys: Sequence[str], time: str, payload: Sequence[str], order: Sequence[str] = (), range_rows: int = RANGE_ROWS, row_group: int = ROW_GROUP) -> DataFrame:
    """Every version of every entity, with the period in which it held.

    ``rows``: the snapshots or updates, each a frame; or one frame, whose rows of one day (in UTC) are then
    taken as a snapshot. Each snapshot is cut into the same buckets by entity, and sorted by entity and time, as
    a run of its own (days that are ``RUNS`` apart share one). Per bucket a merge iterates over all runs at
    once and emits a version when the payload changes, closed when the next one starts. What is kept is a
    block of each run and the last row, never a history.

    All is one plan with one scan of each frame. A bucket of more than ``range_rows`` rows is merged by several
    tasks, each from a place in the sort order on, so that one entity may hold any share of the rows: its rows
    are stored by as many tasks as there are runs, and merged by as many as there are ranges.

    ``time`` is a timestamp, a date, or a bigint of microseconds. The payload has values of simple types.

    Returns the keys, the payload, ``valid_from`` and ``valid_to`` (both of the type of ``time``;
    ``valid_to`` is exclusive and null for the version that still holds).

    Defined cases: rows without a time are no observation and are left out; null is a key value and a
    payload value like any other and equals itself; repeated rows change nothing; rows of one entity at the
    same instant are taken in the order of ``order`` and then of the payload, so that an earlier one of
    them may get a period of no length; late rows count where their time puts them; other columns of
    ``rows`` are ignored, also one named valid_from or valid_to; an empty table has no versions.
    """
    layout = Layout(keys, time, payload, order)
    if isinstance(rows, DataFrame):
        taken = layout.taken(rows)
        micros = F.col("t") if dict(taken.dtypes)["t"] == "bigint" else F.unix_micros(F.col("t").cast("timestamp"))
        run = F.pmod(F.floor(micros / _DAY), F.lit(RUNS))
    else:
        taken = None
        for number, part in enumerate(rows):
            one = layout.taken(part).withColumn("_snapshot", F.lit(number % RUNS))
            taken = one if taken is None else taken.unionByName(one)
        run = F.col("_snapshot")
    spark = taken.sparkSession
    kinds = taken.drop("_snapshot").schema
    manifest = layout.stored(taken, run, run_folder(spark), partitions(spark), row_group)
    return layout.versions(manifest, kinds, range_rows)


class SnapshotStore:
    """Snapshots kept as sorted runs in a folder: another one is added without touching or sorting the others again."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], time: str, payload: Sequence[str], order: Sequence[str] = (), buckets: int = 64) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.layout = Layout(keys, time, payload, order)

    def add(self, snapshot: DataFrame) -> None:
        """Sorts and stores one snapshot."""
        taken = self.layout.taken(snapshot)
        self.kinds = taken.schema
        self.layout.stored(taken, F.lit(uuid4().int & 0x7FFFFFFF), f"{self.folder}/runs", self.buckets).write.mode("append").parquet(f"{self.folder}/manifest")

    def versions(self) -> DataFrame:
        """The history of all snapshots added so far."""
        return self.layout.versions(self.spark.read.parquet(f"{self.folder}/manifest"), self.kinds)


def instant_from_text(text: str | None) -> int | None:
    """Microseconds since 1970 of an ISO date and time; None if it isn't one. Without an offset it is UTC."""
    if not text:
        return None
    try:
        found = datetime.fromisoformat(text.strip())
    except ValueError:
        return None
    if found.tzinfo is None:
        found = found.replace(tzinfo=timezone.utc)
    try:
        delta = found - datetime(1970, 1, 1, tzinfo=timezone.utc)
    except OverflowError:
        return None
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def read_object(text: str | None) -> dict | None:
    """The JSON object that the text is, or None. NaN and Infinity are not JSON."""
    if text is None:
        return None
    try:
        found = read_json(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _as_value(value: object) -> str | None:
    """A text by which two JSON values are equal as values: numbers numerically, text exactly."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "b" + str(value)
    if isinstance(value, int):
        return f"n{value}"
    if isinstance(value, float):
        return f"n{int(value)}" if value.is_integer() else f"n{value!r}"
    if isinstance(value, str):
        return "s" + value.encode("utf-8", "backslashreplace").decode()
    return "j" + json.dumps(value, sort_keys=True)


def record_attributes(records: DataFrame, members: Sequence[str], keep: Sequence[str], time: str = "fetched_at", raw: str = "raw_json") -> DataFrame:
    """The members of each JSON record as values, with its time in microseconds as ``at``.

    Rows without a readable time or without one complete JSON object are left out: they tell nothing.
    """
    members, keep = list(members), list(keep)
    source = records.select(*keep, F.col(time).cast("string").alias("_time"), F.col(raw).alias("_raw"))
    schema = T.StructType([*(T.StructField(c, source.schema[c].dataType) for c in keep), T.StructField("at", T.LongType()), *(T.StructField(m, T.StringType()) for m in members)])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, at, values = [], [], [[] for _ in members]
            for i, (when, text) in enumerate(zip(batch.column("_time").to_pylist(), batch.column("_raw").to_pylist())):
                t = instant_from_text(when)
                found = None if t is None else read_object(text)
                if found is None:
                    continue
                take.append(i)
                at.append(t)
                for out, m in zip(values, members):
                    out.append(_as_value(found.get(m)))
            if take:
                rows = batch.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(at, pa.int64()), *(pa.array(v, pa.string()) for v in values)], names=[*keep, "at", *members])

    return source.mapInArrow(parse, schema)


def value_text(name: str):
    """The plain text of a value made by ``record_attributes``."""
    return F.expr(f"substr({name}, 2)")


#: ISO date and time: date, T or blank, time, fraction, offset. Nothing else is an instant.
_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[Tt ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)([Zz]|[+-]\d{2}:?\d{2})?)?$"


def instant_column(column: str):
    """The same as ``instant_from_text`` for the usual spellings, as a column; empty or unreadable is null."""
    c = F.trim(F.col(column))
    part = lambda i, default: F.when(F.regexp_extract(c, _ISO, i) == "", default).otherwise(F.regexp_extract(c, _ISO, i))
    whole = F.concat(part(1, ""), F.lit(" "), F.regexp_replace(part(2, "00:00:00"), r"^(\d\d:\d\d)$", "$1:00"), part(3, "+00:00"))
    return F.when(c.rlike(_ISO), F.unix_micros(F.try_to_timestamp(whole)))
