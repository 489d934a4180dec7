"""Sinks, sources and relational helpers around results: lines, JSON lines, separated values, archives, collection documents."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltline.operators.materialise import numbered_rows
from siltline.operators.skew import broadcast_if_small


def output_form(column: str, kind: T.DataType) -> Column:
    """Dates and timestamps as ISO text; all else as it is."""
    c = F.col(f"`{column}`")
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        zone = F.lit("+00:00") if isinstance(kind, T.TimestampType) else F.lit("")
        utc = F.to_utc_timestamp(c, F.current_timezone()) if isinstance(kind, T.TimestampType) else c
        fraction = F.when(F.date_format(utc, "SSSSSS") == "000000", "").otherwise(F.concat(F.lit("."), F.date_format(utc, "SSSSSS")))
        return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), fraction, zone)
    return c


def as_json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object per row in ``value``; null members are kept, other alphabets stay readable."""
    formed = F.struct(*(output_form(f.name, f.dataType).alias(f.name) for f in rows.schema.fields))
    return rows.select(F.to_json(formed, {"ignoreNullFields": "false"}).alias("value"))


def as_lines(rows: DataFrame) -> DataFrame:
    """The only column as text in ``value``: null is empty, truth values are lower case, collections are JSON."""
    if len(rows.columns) != 1:
        raise ValueError("lines need exactly one column")
    field = rows.schema.fields[0]
    c = output_form(field.name, field.dataType)
    text = F.to_json(c, {"ignoreNullFields": "false"}) if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string")
    return rows.select(F.coalesce(text, F.lit("")).alias("value"))


def _flat(rows: DataFrame) -> list[Column]:
    """Columns as they stand in separated values: collections as JSON, times as ISO text."""
    return [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else output_form(f.name, f.dataType).alias(f.name) for f in rows.schema.fields]


#: How values are separated: null is empty, a quote is doubled.
_SEPARATED = {"nullValue": "", "emptyValue": "", "escape": '"'}


def as_separated(rows: DataFrame, separator: str) -> DataFrame:
    """Each row as one text in ``value``, with the separator between the columns; without a header."""
    # A table without texts may have columns of no type, which separated values do not take.
    flat = [c.cast("string") if isinstance(f.dataType, T.NullType) else c for c, f in zip(_flat(rows), rows.schema.fields)]
    return rows.select(F.to_csv(F.struct(*flat), {**_SEPARATED, "sep": separator}).alias("value"))


def as_references(rows: DataFrame, form: str, prefix: str = "") -> DataFrame:
    """Ids, or addresses made of a prefix and the id, in ``value``."""
    return rows.select((F.col("id") if form == "ids" else F.concat(F.lit(prefix), "id")).alias("value"))


def as_text(rows: DataFrame) -> DataFrame:
    """Lines for one column, else JSON lines."""
    return as_lines(rows) if len(rows.columns) == 1 else as_json_lines(rows)


def write(rows: DataFrame, path: str, form: str = "auto", url_prefix: str = "") -> None:
    """Writes the rows, in their order, to a folder: lines, jsonl, csv, tsv, ids, urls or auto (lines for one column, else jsonl)."""
    if form == "auto":
        form = "lines" if len(rows.columns) == 1 else "jsonl"
    if form in ("ids", "urls"):
        rows, form = as_references(rows, form, url_prefix), "lines"
    if form in ("csv", "tsv"):
        rows.select(*_flat(rows)).write.options(**_SEPARATED).csv(path, header=True, sep="," if form == "csv" else "\t", lineSep="\n")
    elif form in ("lines", "jsonl"):
        (as_lines(rows) if form == "lines" else as_json_lines(rows)).write.text(path)
    else:
        raise ValueError(f"unknown form {form!r}")


def archived_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of an archive file: the last word of each line; comments (#) and empty lines are skipped."""
    return archived_words(spark.read.text(path))


def archived_words(lines: DataFrame) -> DataFrame:
    """The same for lines in a column ``value``."""
    bare = F.regexp_replace("value", r"^\s+|\s+$", "")
    return lines.filter(~bare.startswith("#") & (bare != "")).select(F.element_at(F.split(bare, r"\s+"), -1).alias("id"))


def without_archived(rows: DataFrame, archive: DataFrame, id: str) -> DataFrame:
    """Rows whose id, as text, is not in the archive. Rows without an id stay."""
    known = archive.select(F.col("id").alias("_archived")).distinct()
    return rows.join(broadcast_if_small(known), rows[id].cast("string") == F.col("_archived"), "left_anti")


def unseen_ids(ids: DataFrame, seen: DataFrame) -> DataFrame:
    """Each id once that ``seen`` does not have; null is no id."""
    return ids.select("id").filter(F.col("id").isNotNull()).distinct().join(seen.select("id"), "id", "left_anti")


def append_unseen(spark: SparkSession, ids: DataFrame, path: str) -> int:
    """Appends ids that a folder of id lines lacks; Spark's commit makes them appear at once. Their number."""
    try:
        seen = spark.read.text(path).select(F.col("value").alias("id"))
    except Exception as e:  # noqa: BLE001 - the folder does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        seen = spark.createDataFrame([], "id string")
    new = unseen_ids(ids, seen).persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").text(path)
        return n
    finally:
        new.unpersist()


def lookup(rows: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    """Rows whose id is among ``ids``."""
    return rows.join(broadcast_if_small(ids.select(id).filter(F.col(id).isNotNull()).distinct()), id, "left_semi")


def fresh(rows: DataFrame, fetched_at: str, max_age: str | int | None, now: datetime) -> DataFrame:
    """Rows not older than ``max_age`` seconds (a number or a column); without one nothing is stale. A row without a time is stale."""
    age = F.col(max_age) if isinstance(max_age, str) else F.lit(max_age).cast("bigint")
    limit = F.lit(int(now.timestamp() * 1_000_000)) - age * 1_000_000
    return rows.filter(age.isNull() | (F.unix_micros(fetched_at) >= limit))


def consistent_values(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per key each value that all non-empty observations agree on, else null. Only extremes are kept while adding up."""

    def agreed(name: str) -> Column:
        known = F.when(F.col(name).cast("string") != "", F.col(name))
        return F.when(F.min(known) == F.max(known), F.min(known)).alias(name)

    return rows.groupBy(*keys).agg(*(agreed(v) for v in values))


def collection_entries(rows: DataFrame, id: str, metadata: Sequence[str]) -> DataFrame:
    """One entry of a collection document per row, as JSON; empty metadata is left out.

    Every row needs a non-empty id; the run fails on one that has none.
    """
    checked = F.when(F.coalesce(F.col(id).cast("string"), F.lit("")) == "", F.raise_error("a collection entry has no id").cast("string")).otherwise(F.col(id).cast("string"))
    return rows.select(F.to_json(F.struct(checked.alias("target"), F.struct(*metadata).alias("metadata"))).alias("entry"))


def collection_lines(rows: DataFrame, id: str, metadata: Sequence[str], playlist: Mapping[str, str], order: Sequence[str], schema: str = "media-collection", version: int = 1) -> DataFrame:
    """The whole document as numbered lines: ``place`` (the head is -1) and ``value``; put together in their order they are one JSON text.

    The rows are sorted by ranges and numbered behind the ranges before them, so that no task or driver holds
    more than its range. Every row needs a non-empty id.
    """
    head = json.dumps({"schema": schema, "version": version, "collection": {"type": "playlist", "metadata": dict(playlist)}, "entries": []}, ensure_ascii=False, separators=(",", ":"))
    spark = rows.sparkSession
    entries = collection_entries(rows.orderBy(*order), id, metadata)
    placed = numbered_rows(entries, "place").select((F.col("place") - 1).alias("place"), F.concat(F.when(F.col("place") == 1, "").otherwise(","), "entry").alias("value"))
    first = spark.createDataFrame([(-1, head[:-2])], "place bigint, value string")
    last = rows.agg(F.count(F.lit(1)).alias("place")).select("place", F.lit("]}").alias("value"))
    return first.unionByName(placed).unionByName(last)


def write_collection(rows: DataFrame, path: str, id: str, metadata: Sequence[str], playlist: Mapping[str, str], order: Sequence[str], **head) -> None:
    """Writes the document to a folder of text files, which are the document in the order of their names."""
    collection_lines(rows, id, metadata, playlist, order, **head).orderBy("place").select("value").write.text(path)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """The ordered targets of a collection document: place (from 0), target, metadata as JSON."""
    schema = "schema string, version int, entries array<struct<target:string,metadata:map<string,string>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("entries").alias("place", "e")).select("place", "e.target", F.to_json("e.metadata").alias("metadata"))


def sequence_fingerprint(rows: DataFrame, id: str, order: Sequence[str]) -> DataFrame:
    """SHA-256 of the ordered ids as a JSON array, in one row.

    The sequence is one value, so one task reads it; it reads a sorted stream and keeps only the running hash.
    """

    def digest(batches):
        import hashlib
        import json

        import pyarrow as pa

        running, first = hashlib.sha256(b"["), True
        for batch in batches:
            for value in batch.column(0).to_pylist():
                running.update((b"" if first else b",") + json.dumps(value, ensure_ascii=False).encode())
                first = False
        running.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([running.hexdigest()])], names=["fingerprint"])

    places = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    ids = rows.select(F.col(id).cast("string").alias("_id"), *places).repartition(1).sortWithinPartitions(*(f"_o{i}" for i in range(len(order))))
    return ids.select("_id").mapInArrow(digest, "fingerprint string")


def schema_listing(rows: DataFrame) -> list[tuple[str, str, bool]]:
    """Field, type and nullability of every column."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in rows.schema.fields]
