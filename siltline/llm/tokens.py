"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file of the tokenizer, the same place on all machines.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The tokenizer's published splitting pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(rows: DataFrame, text: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the length of the whole text. Null and empty text have 0 tokens."""
    base = rows.select(*(F.col(c) for c in keep), F.col(text).alias("_text"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer).encode_ordinary
        for batch in batches:
            coded = batch.column("_text").dictionary_encode()
            distinct = pa.array([len(encode(t)) for t in coded.dictionary.to_pylist()], pa.int64())
            counts = distinct.take(coded.indices).fill_null(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), counts], names=[*keep, "tokens"])

    fields = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in keep)
    return base.mapInArrow(stream, f"{fields}, tokens bigint")
