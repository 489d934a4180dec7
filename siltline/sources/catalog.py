"""Named relations that queries can read."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class Entry:
    """A relation: its rows, the columns that give its order, kinds declared by name, and its facets.

    ``order``: columns whose values are unique together and never null; without them the order is that in
    which Spark reads the rows. ``kinds`` names kinds that neither name nor type tell; ``ordered`` names
    collections in which places mean something. A facet is a condition on the rows, or rows of its own.
    """

    rows: DataFrame
    order: tuple[str, ...] = ()
    kinds: Mapping[str, str] = field(default_factory=dict)
    ordered: tuple[str, ...] = ()
    facets: Mapping[str, Column | DataFrame] = field(default_factory=dict)


class Catalog:
    """Relations by name. Names are case-sensitive; @name and name are the same relation."""

    def __init__(self) -> None:
        self._entries: dict[str, Entry | Callable[[], Entry]] = {}
        self.default: str | None = None

    def register(self, name: str, rows: DataFrame, order: Sequence[str] = (), kinds: Mapping[str, str] | None = None, ordered: Sequence[str] = (), facets: Mapping[str, Column | DataFrame] | None = None, default: bool = False) -> Catalog:
        self._entries[name.removeprefix("@")] = Entry(rows, tuple(order), kinds or {}, tuple(ordered), facets or {})
        if default or self.default is None:
            self.default = name.removeprefix("@")
        return self

    def register_lazily(self, name: str, entry: Callable[[], Entry]) -> Catalog:
        """A relation that is looked up when a query first names it."""
        self._entries[name.removeprefix("@")] = entry
        return self

    def find(self, name: str) -> Entry | None:
        name = name.removeprefix("@")
        found = self._entries.get(name)
        if callable(found):
            found = self._entries[name] = found()
        return found

    def names(self) -> list[str]:
        return sorted(self._entries)


#: Order keys of the driver's tables.
TABLE_ORDER = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",), "media_metadata": (), "source_entries": (), "field_observations": ("observation_id",), "metadata_records": ("record_id",),
}


def table_catalog(spark, directory: str, names: Sequence[str] | None = None) -> Catalog:
    """A catalog of Parquet tables in a directory, read only when a query names them."""
    from siltline.sources.tables import read_table

    def entry(name: str) -> Entry:
        rows = read_table(spark, directory, name)
        facets = {kind: rows["event_type"] == kind for kind in ("click", "error", "purchase", "signup", "view")} if name == "events" else {}
        return Entry(rows, TABLE_ORDER.get(name, ()), ordered=("embedding",), facets=facets)

    catalog = Catalog()
    for name in names or TABLE_ORDER:
        catalog.register_lazily(name, lambda name=name: entry(name))
    return catalog
