"""Small Arrow helpers for operators that stream sorted partitions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def differs_from_previous(batch: pa.RecordBatch | pa.Table, columns: Iterable[str]) -> np.ndarray:
    """For each row but the first: does any of the columns differ from the row before? Null equals null."""
    n = batch.num_rows
    out = np.zeros(max(0, n - 1), dtype=bool)
    for c in columns:
        col = batch.column(c)
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        a, b = col.slice(0, n - 1), col.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False) if col.null_count else pc.not_equal(a, b)
        out |= differ.to_numpy(zero_copy_only=False)
        if col.null_count:
            out |= pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return out


def joined(first: pa.Table | None, batch: pa.RecordBatch) -> pa.Table:
    """The batch as a table, behind the rows kept from before."""
    table = pa.Table.from_batches([batch])
    return table if first is None or not first.num_rows else pa.concat_tables([first, table]).combine_chunks()


def in_batches(table: pa.Table, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """The rows of a table in batches of a bounded size."""
    yield from (b for b in table.combine_chunks().to_batches(max_chunksize=rows) if b.num_rows)
