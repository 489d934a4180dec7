"""Cached metadata records as a relation of the query language."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltline.functions import kinds as k
from siltline.operators.history import instant_column

_TYPES = {"string": "string", "date": "string", "datetime": "double", "boolean": "boolean", "count": "bigint", "duration": "double"}
#: Declared collections of a record (fixed values).
COLLECTIONS = {
    "tags": "array<string>",
    "categories": "array<string>",
    "formats": "array<struct<format_id:string,ext:string,width:bigint,height:bigint,resolution:string,fps:double,aspect_ratio:double,vcodec:string,acodec:string,container:string,protocol:string,dynamic_range:string,tbr:double,vbr:double,abr:double,asr:double,audio_channels:bigint,filesize:bigint,filesize_approx:bigint,language:string,format_note:string>>",
    "chapters": "array<struct<title:string,start_time:bigint,end_time:bigint>>",
    "thumbnails": "array<struct<id:string,url:string,width:bigint,height:bigint>>",
}


def media_records(cached: DataFrame, raw: str = "raw_json", fetched_at: str = "fetched_at", keep: Sequence[str] = (), only_latest: bool = True, order: Sequence[str] = ()) -> DataFrame:
    """One row per media item, with the known fields and collections of its JSON record.

    The JSON is read with a schema, not inferred; members that are none of the declared ones are dropped, a
    member of another shape is null. With ``only_latest`` the latest readable record of an id counts; of equal times
    the greatest by ``order``, then by a hash of the text, so that a result can be repeated.
    """
    schema = T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in [*((n, _TYPES[v]) for n, v in k.KNOWN.items()), *COLLECTIONS.items()]))
    ties = F.struct(*order, F.xxhash64(raw).alias("_hash")).alias("_ties")
    rows = cached.select(*keep, instant_column(fetched_at).alias("_at"), ties, F.from_json(raw, schema).alias("r")).filter(F.col("r.id").isNotNull())
    if only_latest:
        rows = rows.groupBy("r.id").agg(F.max_by(F.struct(*keep, "r"), F.struct(F.col("_at").isNotNull(), "_at", "_ties")).alias("x")).select(*(F.col(f"x.{c}") for c in keep), "x.r")
    return rows.select(*keep, "r.*")


def normalised(rows: DataFrame) -> DataFrame:
    """Only scalars and the declared collections; tags and categories in their order, nulls last."""
    kept = [f for f in rows.schema.fields if f.name in COLLECTIONS or not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    return rows.select(*(F.array_sort(f.name).alias(f.name) if f.name in k.ORDERED and isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in kept))
