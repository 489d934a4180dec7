"""What a source reference means: a channel, a playlist, or another address."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts whose paths are understood, and the address that channels and playlists are given (fixed values).
HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com")
SHORT_HOSTS = ("youtu.be",)
BASE = "https://www.youtube.com"
#: First parts of a path that name a single video, and last parts that name a tab of a channel (fixed values).
VIDEO_PARTS = ("watch", "shorts", "embed")
TABS = ("videos", "shorts", "streams", "featured")
#: Shapes of ids (fixed values).
CHANNEL_ID = r"^UC[A-Za-z0-9_-]{20,}$"
PLAYLIST_ID = r"^(?:PL|UU|LL|FL|RD|UL|TL|OLAK5uy_)[A-Za-z0-9_-]{8,}$"
_PLAYLIST_CHARACTERS = r"^[A-Za-z0-9_-]{8,}$"


def classify(reference: Column, hosts: Sequence[str] = HOSTS, short_hosts: Sequence[str] = SHORT_HOSTS, base: str = BASE) -> Column:
    """A struct (kind, url, id) for each reference: @handle, bare handle, channel id, playlist id, or address.

    ``kind`` is channel, playlist, url (an address of another host) or invalid (empty, a single video, or of
    no known shape; then url and id are null). Null stays null. All is done with columns, so a whole table of
    references is classified where it lies.
    """
    text = F.btrim(reference)
    address = F.regexp_like(text, F.lit(r"^https?://"))
    host = F.lower(F.regexp_extract(text, r"^https?://([^/?#:]*)", 1))
    listed = F.btrim(F.regexp_extract(text, r"[?&]list=([^&#]*)", 1))
    parts = F.filter(F.split(F.regexp_extract(text, r"^https?://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    tabless = F.when(F.lower(F.element_at(parts, -1)).isin(*TABS), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    def made(kind: str, url: Column, id: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), url.cast("string").alias("url"), id.cast("string").alias("id"))

    nothing = F.lit(None).cast("string")
    invalid = made("invalid", nothing, nothing)

    def playlist(id: Column) -> Column:
        return F.when(id.rlike(_PLAYLIST_CHARACTERS), made("playlist", F.concat(F.lit(base + "/playlist?list="), id), id)).otherwise(invalid)

    known = F.when(F.regexp_like(text, F.lit(r"[?&]list=")), playlist(listed)).when(host.isin(*short_hosts) | (F.size(parts) == 0) | F.get(parts, F.lit(0)).isin(*VIDEO_PARTS, "playlist") | (F.size(tabless) == 0), invalid).otherwise(made("channel", F.concat(F.lit(base + "/"), F.array_join(tabless, "/")), nothing))
    return (
        F.when(text.isNull(), F.lit(None))
        .when(address & host.isin(*hosts, *short_hosts), known)
        .when(address, made("url", text, nothing))
        .when(text.rlike(CHANNEL_ID), made("channel", F.concat(F.lit(base + "/channel/"), text), text))
        .when(text.rlike(PLAYLIST_ID), playlist(text))
        .when(text.startswith("@") & (F.length(text) > 1), made("channel", F.concat(F.lit(base + "/"), text), text))
        .when(text.rlike(r"^[A-Za-z0-9_.-]+$"), made("channel", F.concat(F.lit(base + "/@"), text), text))
        .otherwise(invalid)
    )
