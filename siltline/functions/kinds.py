"""Kinds of values, and the kinds of a DataFrame's columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields whose kind is known by name (fixed values).
KNOWN = {
    "id": "string", "title": "string", "upload_date": "date", "publish_date": "date", "duration": "duration", "view_count": "count", "like_count": "count", "comment_count": "count",
    "channel_follower_count": "count", "playlist_index": "count", "source_index": "count", "uploader": "string", "uploader_id": "string", "channel": "string", "channel_id": "string",
    "live_status": "string", "availability": "string", "is_live": "boolean", "was_live": "boolean", "webpage_url": "string", "playlist_id": "string", "playlist_title": "string",
    "timestamp": "datetime", "release_timestamp": "datetime", "modified_timestamp": "datetime",
}
#: Other names of fields (fixed values).
ALIASES = {"views": "view_count", "likes": "like_count", "comments": "comment_count", "date": "upload_date", "url": "webpage_url"}
#: Collections that have an order of their own, so that places in them mean something (fixed values).
ORDERED = ("tags", "categories")
#: Text fields that are compared without regard to case against a literal (fixed values).
CASELESS = ("live_status", "availability")
#: Kinds of members that are more than their type says, by collection (fixed values).
MEMBERS = {
    "formats": {"width": "count", "height": "count", "audio_channels": "count", "filesize": "count", "filesize_approx": "count"},
    "chapters": {"start_time": "duration", "end_time": "duration"},
    "thumbnails": {"width": "count", "height": "count"},
}
NUMERIC = ("integer", "number", "count", "duration")


@dataclass(frozen=True)
class Kind:
    """name; for collections the element and whether it is ordered, for structures the members, for timestamps whether they name no zone (then UTC)."""

    name: str
    element: Kind | None = None
    members: Mapping[str, Kind] = field(default_factory=dict, hash=False)
    ordered: bool = False
    naive: bool = False

    @property
    def numeric(self) -> bool:
        return self.name in NUMERIC


STRING, INTEGER, NUMBER, BOOLEAN, UNKNOWN, DATE, DATETIME, DURATION, COUNT = map(Kind, ("string", "integer", "number", "boolean", "unknown", "date", "datetime", "duration", "count"))


def kind_of_type(kind: T.DataType, name: str = "", ordered: bool = False) -> Kind:
    """The kind that a Spark type stands for."""
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return STRING
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(kind, T.DecimalType):
        return INTEGER if kind.scale == 0 else NUMBER
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return NUMBER
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, T.DateType):
        return DATE
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return Kind("datetime", naive=isinstance(kind, T.TimestampNTZType))
    if isinstance(kind, T.ArrayType):
        return Kind("collection", kind_of_type(kind.elementType, name), ordered=ordered or name in ORDERED)
    if isinstance(kind, T.StructType):
        known = MEMBERS.get(name, {})
        return Kind("structured", members={f.name: Kind(known[f.name]) if f.name in known else kind_of_type(f.dataType) for f in kind.fields})
    return UNKNOWN


def _whole(column: Column, kind: T.DataType) -> Column:
    """As a whole number of 64 bits; null where it has more."""
    return column.try_cast("bigint") if isinstance(kind, (T.DecimalType, T.FloatType, T.DoubleType)) else column.cast("bigint")


def read_as(column: Column, name: str, kind: T.DataType, declared: str | None = None, ordered: bool = False) -> tuple[Column, Kind]:
    """A source column in the form that its kind has here, and the kind.

    Known names and endings decide, where the type allows it; else the type does.
    """
    by_type = kind_of_type(kind, name, ordered)
    low = name.lower()
    wanted = declared or KNOWN.get(low)
    if wanted is None and by_type.name in ("string", "integer", "number"):
        wanted = "datetime" if low.endswith("_timestamp") else "date" if low.endswith("_date") else "count" if low.endswith(("_count", "_index")) else None
    if wanted is None or wanted == by_type.name:
        if by_type.name == "integer":
            return _whole(column, kind), by_type
        # Decimals stay exact; other numbers are doubles.
        return (column if by_type.name != "number" or isinstance(kind, T.DecimalType) else column.cast("double")), by_type
    if wanted == "date" and by_type.name == "string":
        return F.coalesce(F.try_to_date(column, "yyyyMMdd"), F.try_to_date(column, "yyyy-MM-dd")), DATE
    if wanted == "date" and by_type.name == "integer":
        return F.try_to_date(column.cast("string"), "yyyyMMdd"), DATE
    if wanted == "datetime" and by_type.numeric:
        return F.timestamp_micros((column * 1_000_000).cast("bigint")), DATETIME
    if wanted == "datetime" and by_type.name == "string":
        return F.timestamp_micros((column.try_cast("double") * 1_000_000).cast("bigint")), DATETIME
    if wanted in ("count", "duration", "integer") and by_type.numeric:
        return _whole(column, kind), Kind(wanted)
    if wanted == "number" and by_type.numeric:
        return column.cast("double"), NUMBER
    if wanted == "string" and by_type.name in ("integer", "number", "boolean"):
        return column.cast("string"), STRING
    return column, by_type


def common(a: Kind, b: Kind) -> Kind | None:
    """The kind that values of both have, if there is one. Unknown yields; different numbers make a number."""
    if a == b or b.name == "unknown":
        return a
    if a.name == "unknown":
        return b
    if a.name == b.name and a.name in ("collection", "structured", "datetime"):
        return a
    if a.numeric and b.numeric:
        return a if a.name == b.name else NUMBER
    return None
