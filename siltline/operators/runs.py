"""Sorted runs: rows stored by bucket in sorted files of the folder that all executors share, and merged from there.

A plan that stores runs stays lazy. Its first stage writes the files and passes on only a manifest: one row per file,
with the place of the file and the sort keys that its row groups begin with. Later stages open the files that their
part of the manifest names. A task that is run again writes files of new names, so the manifest only ever names whole
files; files outlive the executor that wrote them.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.operators.arrow import differs_from_previous
from siltline.operators.materialise import shared_folder

#: Rows of a row group: what a merge holds of each run, and the step in which it can seek.
ROW_GROUP = 16_384
#: Runs that the rows of a bucket are spread over at most; bounds the files that one merge opens.
RUNS = 32
#: Rows of a bucket from which on several tasks share its merge, each taking a range of the sort order.
RANGE_ROWS = 1_000_000

MANIFEST = "bucket bigint, run bigint, path string, size bigint, marks binary"
Key = tuple


def run_folder(spark: SparkSession) -> str:
    """A new subfolder for the runs of one plan. It goes with the application."""
    shared_folder(spark)
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{context.getCheckpointDir()}/runs-{uuid4().hex}")
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return str(files.makeQualified(path).toString())


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of an address and the path in it, for any system that Arrow knows (file, hdfs, s3, gs, abfs)."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(uri)


def _orderable(value: object) -> tuple:
    """Nulls first, NaN last, as Spark sorts in ascending order."""
    return (0,) if value is None else (2,) if value != value else (1, value)


def key_at(table: pa.Table | pa.RecordBatch, i: int, sort: Sequence[str]) -> Key:
    return tuple(_orderable(table.column(c)[i].as_py()) for c in sort)


def first_not_below(table: pa.Table, key: Key, sort: Sequence[str]) -> int:
    return bisect_left(range(table.num_rows), key, key=lambda i: key_at(table, i, sort))


def first_above(table: pa.Table, key: Key, sort: Sequence[str]) -> int:
    return bisect_right(range(table.num_rows), key, key=lambda i: key_at(table, i, sort))


class RunFile:
    """One run of one bucket, as it is written."""

    def __init__(self, folder: str, bucket: int, run: int, sort: Sequence[str], row_group: int) -> None:
        self.bucket, self.run, self.sort, self.row_group = bucket, run, sort, row_group
        self.uri = f"{folder}/{bucket}-{run}-{uuid4().hex}.parquet"
        self.files, self.path = _opened(self.uri)
        self.sink = self.writer = None
        self.held: list[pa.Table] = []
        self.waiting = self.size = 0
        self.marks: list[Key] = []

    def add(self, rows: pa.Table) -> None:
        self.held.append(rows)
        self.waiting += rows.num_rows
        if self.waiting >= self.row_group:
            self.flush()

    def flush(self) -> None:
        rows = pa.concat_tables(self.held)
        if self.writer is None:
            self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
            self.sink = self.files.open_output_stream(self.path)
            self.writer = pq.ParquetWriter(self.sink, rows.schema, compression="zstd", write_statistics=False)
        for at in range(0, rows.num_rows, self.row_group):
            part = rows.slice(at, self.row_group)
            self.marks.append(key_at(part, 0, self.sort))
            self.writer.write_table(part, row_group_size=self.row_group)
        self.size += rows.num_rows
        self.held, self.waiting = [], 0

    def close(self) -> dict:
        if self.held:
            self.flush()
        self.writer.close()
        self.sink.close()
        return {"bucket": self.bucket, "run": self.run, "path": self.uri, "size": self.size, "marks": pickle.dumps(self.marks)}


def write_runs(rows: DataFrame, folder: str, sort: Sequence[str], marked: Sequence[str] | None = None, row_group: int = ROW_GROUP) -> DataFrame:
    """Stores rows with the columns ``bucket`` and ``run``, whose partitions are sorted by these and ``sort``; the manifest.

    ``marked``: the sort columns that row groups are found by (by default all).
    """
    columns = [c for c in rows.columns if c not in ("bucket", "run")]
    by = list(sort if marked is None else marked)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file: RunFile | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            edges = [0, *(np.flatnonzero(differs_from_previous(batch, ["bucket", "run"])) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                own = (table.column("bucket")[lo].as_py(), table.column("run")[lo].as_py())
                if file is None or (file.bucket, file.run) != own:
                    if file is not None:
                        yield _manifest([file.close()])
                    file = RunFile(folder, *own, by, row_group)
                file.add(table.select(columns).slice(lo, hi - lo))
        if file is not None:
            yield _manifest([file.close()])

    return rows.mapInArrow(write, MANIFEST)


def _manifest(records: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(records, schema=pa.schema([("bucket", pa.int64()), ("run", pa.int64()), ("path", pa.string()), ("size", pa.int64()), ("marks", pa.binary())]))


def spread_by_run(rows: DataFrame, number: int, sort: Sequence[Column | str]) -> DataFrame:
    """Rows brought to the task of their bucket and run, evenly, and sorted by bucket, run and ``sort``."""
    return rows.repartitionById(number, F.pmod(F.col("bucket") + F.col("run"), F.lit(number)).cast("int")).sortWithinPartitions("bucket", "run", *sort)


class Run:
    """A stored run that is read from a place on, row group by row group."""

    def __init__(self, path: str, marks: list[Key], sort: Sequence[str]) -> None:
        files, inner = _opened(path)
        self.file = pq.ParquetFile(files.open_input_file(inner))
        self.marks, self.sort = marks, sort

    def group(self, i: int) -> pa.Table:
        return self.file.read_row_group(i, use_threads=False)

    def since(self, key: Key | None) -> tuple[pa.Table | None, Iterator[pa.Table]]:
        """The row before a key, if there is one, and the rows from the key on; all rows for None."""
        if key is None:
            return None, (self.group(i) for i in range(len(self.marks)))
        start = max(0, bisect_left(self.marks, key) - 1)
        first = self.group(start)
        at = first_not_below(first, key, self.sort)
        before = first.slice(at - 1, 1) if at else None

        def rest() -> Iterator[pa.Table]:
            if at < first.num_rows:
                yield first.slice(at)
            yield from (self.group(i) for i in range(start + 1, len(self.marks)))

        return before, rest()


def merge_blocks(runs: Iterable[Iterator[pa.Table]], sort: Sequence[str]) -> Iterator[pa.Table]:
    """The k-way merge of sorted runs, in blocks.

    Of all runs' present blocks, the one that ends first bounds what is certain: all rows up to its end are merged
    and handed on, and only runs that are used up read their next block. A merge holds one block of each run.
    """
    order = [(c, "ascending") for c in sort]
    live = [(head, run) for run in runs if (head := next(run, None)) is not None]
    while live:
        ends = [key_at(head, head.num_rows - 1, sort) for head, _ in live]
        bound = min(ends)
        certain, going = [], []
        for (head, run), end in zip(live, ends):
            n = head.num_rows if end <= bound else first_above(head, bound, sort)
            if n:
                certain.append(head.slice(0, n))
            left = head.slice(n) if n < head.num_rows else next(run, None)
            if left is not None:
                going.append((left, run))
        live = going
        table = pa.concat_tables(certain).combine_chunks()
        yield table if len(certain) == 1 else table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_start"))


def merge_ranges(manifest: DataFrame, number: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """What is to be merged: per bucket its files and, where these hold many rows, ranges of the sort order between which tasks divide them.

    The ranges end at sort keys that row groups begin with, so that a bucket that a single entity fills is
    divided as well. One column ``item``, spread over ``number`` partitions.
    """
    files = manifest.groupBy("bucket").agg(F.collect_list(F.struct("path", "size", "marks")).alias("files"))  # one per run

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, found in zip(batch.column("bucket").to_pylist(), batch.column("files").to_pylist()):
                own = sorted((f["path"], pickle.loads(f["marks"])) for f in found)
                parts = -(-sum(f["size"] for f in found) // range_rows)
                marks = sorted({m for _, ms in own for m in ms})
                cuts = sorted({marks[len(marks) * i // parts] for i in range(1, parts)}) if parts > 1 else []
                bounds = [None, *cuts, None]
                items = [pickle.dumps((own, lo, hi)) for lo, hi in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([(bucket + i) % number for i in range(len(items))], pa.int32()), pa.array(items, pa.binary())], names=["at", "item"])

    return files.mapInArrow(divide, "at int, item binary").repartitionById(number, "at").select("item")


def items_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[str, list[Key]]], Key | None, Key | None]]:
    for batch in batches:
        for item in batch.column("item").to_pylist():
            yield pickle.loads(item)
