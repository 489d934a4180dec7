"""From a parsed query to a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltline.functions import kinds as k
from siltline.functions.literals import Clock
from siltline.operators.materialise import materialise, numbered_rows
from siltline.plans import nodes as n
from siltline.plans.errors import SemanticError
from siltline.plans.expressions import _SPARK, Expressions, Field, Scope, has_aggregate, walk
from siltline.plans.formatter import expression_text
from siltline.sources.catalog import Catalog, Entry

#: Rows up to which a numbering may be done by one task; it is only used behind a LIMIT.
ONE_TASK_ROWS = 1_000_000
_JOINS = {"inner": "inner", "left": "left_outer", "semi": "left_semi", "anti": "left_anti"}
_ids = count()


@dataclass(frozen=True)
class Relation:
    """Rows with internal columns: fields, and columns that give the order.

    ``order``: (column, descending), nulls last. ``plain``: the order columns ascend and are never null, so
    that the least of a set is its first. ``open``: the rows come from one source without declared order, and
    their places are not yet numbered (``order`` ends with the column that will hold them). Filters and
    projections leave that order as it is, so rows are numbered behind them; a number below a filter would
    keep it from the scan.
    """

    df: DataFrame
    fields: tuple[Field, ...]
    order: tuple[tuple[str, bool], ...]
    plain: bool
    open: bool = False

    def placed(self) -> Relation:
        """The same with all order columns in place."""
        if not self.open:
            return self
        return replace(self, df=self.df.withColumn(self.order[-1][0], F.monotonically_increasing_id()), open=False)

    def places(self) -> list[str]:
        """The order columns that are there."""
        return [c for c, _ in (self.order[:-1] if self.open else self.order)]

    def sorted(self) -> DataFrame:
        return self.placed().df.orderBy(*sort_columns(self.order))

    def named(self, ordered: bool) -> DataFrame:
        """The rows under the fields' names."""
        return (self.sorted() if ordered else self.df).select(*(F.col(f.column).alias(f.name) for f in self.fields))


def sort_columns(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]


def first_of(order: Sequence[str]) -> Column:
    """The least place, as one value. One column stays a number, which aggregates by hashing."""
    return F.min(order[0]) if len(order) == 1 else F.min(F.struct(*order))


def places_of(column: str, order: Sequence[str]) -> list[Column]:
    """The order columns of a least place."""
    return [F.col(column).alias(order[0])] if len(order) == 1 else [F.col(column)[c].alias(c) for c in order]


def fresh(prefix: str) -> str:
    return f"{prefix}{next(_ids)}"


@dataclass(frozen=True)
class Stage:
    """A projected body before DISTINCT and slicing: outputs, sort keys of ORDER BY, and the order below them."""

    df: DataFrame
    fields: tuple[Field, ...]
    keys: tuple[tuple[str, bool], ...]
    order: tuple[tuple[str, bool], ...]
    plain: bool
    numbered: tuple[str, ...] = ()  # outputs that are POSITION()
    open: bool = False


class Lowering:
    """Lowers one query. ``decisions`` is a log of what was chosen."""

    def __init__(self, text: str, catalog: Catalog, clock: Clock, reverse: bool = False) -> None:
        self.text, self.catalog, self.reverse = text, catalog, reverse
        self.ex = Expressions(text, clock)
        self.ctes: dict[str, Relation] = {}
        self.decisions: list[dict] = []

    def fail(self, message: str, node: n.Node) -> SemanticError:
        return SemanticError(self.text, message, node.at)

    def note(self, what: str, **details) -> None:
        self.decisions.append({"step": what, **details})

    # Queries

    def statement(self, query: n.Query) -> Relation:
        for name, inner in query.ctes:
            found = self.query(inner)
            if any(isinstance(x, n.Call) and x.name == "RANDOM" and not x.args for x in _all_nodes(inner)):
                self.note("materialise", cte=name, reason="RANDOM() must keep its values")
                found = replace(found, df=materialise(found.df))
            self.ctes[name] = found
        return self.query(query)

    def query(self, query: n.Query) -> Relation:
        if len(query.branches) == 1 and isinstance(query.branches[0], n.Select):
            return self.finish(self.body(query.branches[0], query.order, query), query)
        parts = [self.query(b) if isinstance(b, n.Query) else self.query(n.Query((b,), at=b.at)) for b in query.branches]
        for b in query.branches:
            if len(query.branches) > 1 and isinstance(b, n.Select) and any(isinstance(t.expr, n.Call) and t.expr.name == "POSITION" for t in b.terms or ()):
                raise self.fail("POSITION() is not allowed in a UNION branch.", b)
        found = parts[0]
        if len(parts) > 1:
            run, pending = [found], []
            for right, all_ in zip(parts[1:], query.alls):
                run.append(right)
                pending.append(all_)
                if not all_:  # copies of everything so far go
                    found = self.unique(self.union(run, query), ())
                    run = [found]
            found = self.union(run, query) if len(run) > 1 else run[0]
        keys: list[tuple[str, bool]] = []
        df = found.df
        for o in query.order:
            if isinstance(o.expr, (n.Literal, n.Temporal)):
                raise self.fail("ORDER BY takes fields and expressions, not places.", o)
            name = fresh("k")
            column, _ = self.ex.scalar(o.expr, Scope([(None, found.fields)]))
            df = df.withColumn(name, column)
            keys.append((name, o.descending))
        return self.slice(Relation(df, found.fields, (*keys, *found.order), found.plain and not keys, found.open), query)

    def finish(self, stage: Stage, query: n.Query) -> Relation:
        select = query.branches[0]
        order = (*stage.keys, *stage.order)
        found = Relation(stage.df, stage.fields, order, stage.plain and not stage.keys, stage.open)
        if isinstance(select, n.Select) and select.distinct:
            found = self.unique(found, stage.numbered)
        if stage.numbered:
            return self.numbered(found, stage.numbered, query)
        return self.slice(found, query)

    def slice(self, found: Relation, query: n.Query) -> Relation:
        if query.limit is None and not query.offset:
            return found
        df = found.sorted()
        if query.offset:
            df = df.offset(query.offset)
        if query.limit is not None:
            df = df.limit(query.limit)
        return replace(found, df=df, open=False)

    def numbered(self, found: Relation, columns: Sequence[str], query: n.Query) -> Relation:
        """POSITION(): the row's place in the final order, counted before OFFSET and LIMIT."""
        last = None if query.limit is None else query.limit + (query.offset or 0)
        if last is not None and last <= ONE_TASK_ROWS:
            df = found.sorted().limit(last).withColumn("_place", F.row_number().over(W.orderBy(*sort_columns(found.order))))
        else:  # sorted by ranges; each partition is numbered behind the ones before it
            self.note("materialise", reason="POSITION() over all rows")
            df = numbered_rows(found.sorted(), "_place")
        for c in columns:
            df = df.withColumn(c, F.col("_place").cast("bigint"))
        if query.offset:
            df = df.filter(F.col("_place") > query.offset)
        if last is not None:
            df = df.filter(F.col("_place") <= last)
        return replace(found, df=df, open=False)

    def unique(self, found: Relation, besides: Sequence[str]) -> Relation:
        """The first row of each distinct combination of fields."""
        found = found.placed()
        keys = [f.column for f in found.fields if f.column not in besides]
        ord_ = [c for c, _ in found.order]
        if found.plain and ord_:  # the least ordinal, with partial aggregation
            first = found.df.groupBy(*keys).agg(first_of(ord_).alias("_first"))
            df = first.select(*keys, *(F.lit(0).cast("bigint").alias(c) for c in besides), *places_of("_first", ord_))
        else:
            self.note("distinct", method="first row per key by the sort order")
            place = F.row_number().over(W.partitionBy(*keys).orderBy(*sort_columns(found.order)))
            df = found.df.withColumn("_n", place).filter(F.col("_n") == 1).drop("_n")
        return replace(found, df=df)

    def union(self, parts: Sequence[Relation], query: n.Query) -> Relation:
        """The parts one after the other. Each part keeps order columns of its own, null elsewhere."""
        parts = [p.placed() for p in parts]
        width = len(parts[0].fields)
        kinds = [f.kind for f in parts[0].fields]
        for p in parts[1:]:
            if len(p.fields) != width:
                raise self.fail(f"UNION branches have {width} and {len(p.fields)} columns.", query)
            for i, f in enumerate(p.fields):
                both = k.common(kinds[i], f.kind)
                if both is None:
                    raise self.fail(f"UNION mixes {kinds[i].name} and {f.kind.name} in column {parts[0].fields[i].name!r}.", query)
                kinds[i] = both
        names = [fresh("c") for _ in kinds]
        branch = fresh("b")
        orders = [[(fresh("o"), down) for _, down in p.order] for p in parts]
        dfs = []
        for i, p in enumerate(parts):
            own = dict(zip((c for c, _ in orders[i]), (c for c, _ in p.order)))
            types = {c: q.df.schema[old].dataType for q, o in zip(parts, orders) for (c, _), (old, _) in zip(o, q.order)}
            dfs.append(p.df.select(
                *((F.col(f.column).cast(_SPARK[kind.name]) if f.kind != kind and kind.name in _SPARK and kind.name != "datetime" else F.col(f.column)).alias(c) for c, f, kind in zip(names, p.fields, kinds)),
                F.lit(i).alias(branch),
                *((F.col(own[c]) if c in own else F.lit(None).cast(types[c])).alias(c) for o in orders for c, _ in o),
            ))
        df = dfs[0]
        for other in dfs[1:]:
            df = df.union(other)
        fields = tuple(Field(f.name, c, kind, df.schema[c].dataType) for f, c, kind in zip(parts[0].fields, names, kinds))
        # Within a branch the columns of the others are all null, which any comparison takes as equal.
        return Relation(df, fields, ((branch, False), *(x for o in orders for x in o)), all(p.plain for p in parts))

    # Sources

    def scan(self, entry: Entry, rows: DataFrame, extra: str | None = None) -> Relation:
        """The rows of a source under internal names; ``extra``: a further column, kept under its own name."""
        # Columns are taken by place, as Spark may not tell names apart that differ in case.
        kept = [F.col(extra)] if extra else []
        taken = {f.name: f"s{i}" for i, f in enumerate(rows.schema.fields) if f.name != extra}
        rows, declared = rows.toDF(*(taken.get(c, c) for c in rows.columns)), [f for f in rows.schema.fields if f.name != extra]
        fields, columns = [], []
        for f in declared:
            if f.name.startswith("_"):
                continue
            name = fresh("c")
            column, kind = k.read_as(F.col(taken[f.name]), f.name, f.dataType, entry.kinds.get(f.name), f.name in entry.ordered)
            if f.name in k.ORDERED and isinstance(f.dataType, T.ArrayType):
                column = F.array_sort(column)
            columns.append(column.alias(name))
            fields.append((f.name, name, kind))
        order = [(fresh("o"), self.reverse) for _ in entry.order or ("",)]
        df = rows.select(*columns, *(F.col(taken[c]).alias(o) for c, (o, _) in zip(entry.order, order)), *kept)
        return Relation(df, tuple(Field(a, c, kind, df.schema[c].dataType) for a, c, kind in fields), tuple(order), not self.reverse, not entry.order)

    def anew(self, found: Relation) -> Relation:
        """The same rows under other internal names, so that a relation can meet itself."""
        names = {c: fresh("c") for c in [*(f.column for f in found.fields), *(c for c, _ in found.order)]}
        df = found.df.select(*(F.col(c).alias(names[c]) for c in [*(f.column for f in found.fields), *found.places()]))
        return Relation(df, tuple(replace(f, column=names[f.column]) for f in found.fields), tuple((names[c], d) for c, d in found.order), found.plain, found.open)

    def operand(self, source: n.Source | None, facet: str | None) -> tuple[Relation, bool]:
        """A relation, and whether it exports exactly its columns (a CTE or a derived one)."""
        if source is None:
            if self.catalog.default is None:
                raise SemanticError(self.text, "The query has no FROM and there is no default relation.")
            entry = self.catalog.find(self.catalog.default)
            return self.scan(entry, entry.rows), False
        if source.query is not None:
            return self.query(source.query), True
        if source.name in self.ctes and not source.quoted:
            if facet:
                raise self.fail("A CTE has no facets.", source)
            return self.anew(self.ctes[source.name]), True
        entry = self.catalog.find(source.name)
        if entry is None:
            raise self.fail(f"Unknown relation {source.name!r}.", source)
        if facet is None:
            return self.scan(entry, entry.rows), False
        if facet not in entry.facets:
            raise self.fail(f"Relation {source.name!r} has no facet {facet!r}.", source)
        part = entry.facets[facet]
        return self.scan(entry, part if isinstance(part, DataFrame) else entry.rows.filter(part)), False

    # Bodies

    def body(self, select: n.Select, order: Sequence[n.Order], query: n.Query) -> Stage:
        facets = select.source.facets if select.source else ()
        if len(facets) < 2:
            return self.one_body(select, order, facets[0] if facets else None)
        entry = self.catalog.find(select.source.name) if select.source.name else None
        conditions = [entry.facets.get(f) for f in facets] if entry and not (select.source.name in self.ctes and not select.source.quoted) else []
        if conditions and not select.join and all(isinstance(c, Column) for c in conditions) and (select.group or not self.aggregates(select, order)):
            self.note("facets", method="one scan", facets=list(facets))
            return self.one_body(select, order, None, conditions)
        stages = [self.one_body(select, order, f) for f in facets]
        parts = [Relation(s.df, (*s.fields, *(Field(c, c, k.UNKNOWN, T.NullType()) for c, _ in s.keys)), s.order, s.plain) for s in stages]
        parts = [replace(p, fields=tuple(replace(f, kind=k.Kind("structured")) if f.kind == k.UNKNOWN else f for f in p.fields)) for p in parts]
        merged = self.union(parts, query)
        width = len(stages[0].fields)
        fields = tuple(replace(f, kind=s.kind) for f, s in zip(merged.fields[:width], stages[0].fields))
        keys = tuple((f.column, down) for f, (_, down) in zip(merged.fields[width:], stages[0].keys))
        numbered = tuple(f.column for f, s in zip(fields, stages[0].fields) if s.column in stages[0].numbered)
        return Stage(merged.df, fields, keys, merged.order, merged.plain, numbered)

    def aggregates(self, select: n.Select, order: Sequence[n.Order]) -> bool:
        return bool(select.group) or select.having is not None or has_aggregate((tuple(t.expr for t in select.terms or ()), tuple(o.expr for o in order)))

    def faceted(self, entry: Entry, conditions: Sequence[Column]) -> Relation:
        """A source once per facet that a row belongs to, from one scan; the number of the facet is the first place."""
        memberships = F.array_compact(F.array(*(F.when(c, F.lit(i)) for i, c in enumerate(conditions))))
        rows = entry.rows.filter(reduce(lambda a, b: a | b, conditions)).withColumn("_facets", memberships)
        found = self.scan(entry, rows, "_facets")
        facet = fresh("o")
        df = found.df.select("*", F.explode(F.col("_facets")).alias(facet)).drop("_facets")
        # Behind explode the copies of a row stay in the order of the rows, so numbering still waits.
        return replace(found, df=df, order=((facet, False), *found.order))

    def one_body(self, select: n.Select, order: Sequence[n.Order], facet: str | None, conditions: Sequence[Column] = ()) -> Stage:
        left, exported = (self.faceted(self.catalog.find(select.source.name), conditions), False) if conditions else self.operand(select.source, facet)
        relations: list[tuple[str | None, Sequence[Field]]] = [(_alias(select.source), left.fields)]
        base, shown, wildcard = left, list(relations), {"": (left, exported)}
        if _alias(select.source):
            wildcard[_alias(select.source)] = (left, exported)
        if select.join:
            base, shown = self.join(select, left, relations[0], wildcard)
        scope = Scope(shown, joined=select.join is not None)
        for node in walk((select.where, select.group, select.having)):
            if isinstance(node, n.Call) and node.name == "RANDOM" and not node.args:
                raise self.fail("RANDOM() is not allowed in WHERE, GROUP BY or HAVING.", node)
        df = base.df
        if select.where is not None:
            if has_aggregate(select.where):
                raise self.fail("WHERE cannot contain aggregates; use HAVING.", select.where)
            df = df.filter(self.ex.predicate(select.where, scope))
        terms = self.expanded(select, wildcard)
        aliases = {t.alias: t.expr for t in terms if t.alias is not None}
        for o in order:
            if isinstance(o.expr, n.Literal):
                raise self.fail("ORDER BY takes fields and expressions, not places.", o)
        if select.group or select.having is not None or has_aggregate((tuple(t.expr for t in terms), tuple(o.expr for o in order))):
            return self.grouped(select, replace(base, df=df), scope, terms, order, aliases, base.order[0][0] if conditions else None)
        return self.project(replace(base, df=df), scope, terms, order, aliases)

    def join(self, select: n.Select, left: Relation, first: tuple, wildcard: dict) -> tuple[Relation, list]:
        j = select.join
        right, exported = self.operand(j.right, j.right.facets[0] if j.right.facets else None)
        a, b = _alias(select.source), _alias(j.right)
        if select.source.alias is None or j.right.alias is None:
            raise self.fail("Each relation of a JOIN needs an alias.", j)
        if a == b:
            raise self.fail(f"Relation alias {a!r} is used twice.", j)
        if has_aggregate(j.on) or any(isinstance(x, n.Call) and x.name == "RANDOM" for x in walk(j.on)):
            raise self.fail("ON cannot contain aggregates or RANDOM.", j)
        on = self.ex.predicate(j.on, Scope([first, (b, right.fields)], joined=True))
        where, matched = _conjuncts(select.where) if select.where is not None else [], _conjuncts(j.on)
        left = self.narrowed(left, first, where + (matched if j.kind in ("inner", "semi") else [])).placed()
        right = self.narrowed(right, (b, right.fields), matched + (where if j.kind == "inner" else []))
        right = right if j.kind in ("semi", "anti") else right.placed()
        df = left.df.join(right.df, on, _JOINS[j.kind])
        self.note("join", kind=j.kind, equalities=sum(isinstance(x, n.Compare) and x.op == "=" for x in _conjuncts(j.on)), strategy="chosen by the optimiser from sizes at run time")
        if j.kind in ("semi", "anti"):
            return replace(left, df=df), [first]
        wildcard[b] = (right, exported)
        return Relation(df, (*left.fields, *right.fields), (*left.order, *right.order), left.plain and right.plain), [first, (b, right.fields)]

    def narrowed(self, side: Relation, named: tuple, conditions: Sequence[n.Node]) -> Relation:
        """A side whose rows are not yet numbered, filtered by those conditions that speak of it alone."""
        for c in conditions if side.open else ():
            if has_aggregate(c) or any(isinstance(x, n.Call) and x.name in ("RANDOM", "POSITION") for x in walk(c)):
                continue
            try:
                side = replace(side, df=side.df.filter(self.ex.predicate(c, Scope([named], joined=True))))
            except SemanticError:  # it speaks of the other side too
                continue
        return side

    def expanded(self, select: n.Select, wildcard: Mapping[str, tuple[Relation, bool]]) -> list[n.Term]:
        """The select terms with wildcards written out; every output has a name of its own."""
        terms = select.terms if select.terms is not None else (n.Term(n.Name(("id",), at=select.at), at=select.at),)
        out: list[n.Term] = []
        for t in terms:
            if t.star is None:
                out.append(t)
                continue
            if select.group or select.having is not None:
                raise self.fail("* is not allowed with GROUP BY or HAVING.", t)
            if t.star not in wildcard:
                raise self.fail(f"Unknown relation {t.star!r}.", t)
            relation, exported = wildcard[t.star]
            alias = t.star or _alias(select.source)
            fields = relation.fields if exported else _starred(relation.fields)
            out += [n.Term(n.Name((alias, f.name) if alias else (f.name,), at=t.at), f.name if not select.join else None, at=t.at) for f in fields]
        names: set[str] = set()
        for t in out:
            name = output_name(t)
            if name in names:
                raise self.fail(f"Output name {name!r} is used twice; give one an alias.", t)
            names.add(name)
        return out

    def drawn(self, df: DataFrame, nodes: object) -> tuple[DataFrame, dict[int, Column]]:
        """RANDOM() call sites as columns, so that each has one value per row wherever it is used."""
        out: dict[int, Column] = {}
        for node in walk(nodes):
            if isinstance(node, n.Call) and node.name == "RANDOM" and not node.args and node.at not in out:
                name = fresh("r")
                df, out[node.at] = df.withColumn(name, F.rand()), F.col(name)
        return df, out

    def project(self, base: Relation, scope: Scope, terms: Sequence[n.Term], order: Sequence[n.Order], aliases: Mapping[str, n.Node]) -> Stage:
        df, drawn = self.drawn(base.df, (tuple(t.expr for t in terms), tuple(o.expr for o in order)))
        scope = scope.with_(drawn=drawn)
        fields, columns, numbered, by_alias = [], [], [], {}
        for t in terms:
            name = fresh("c")
            if isinstance(t.expr, n.Call) and t.expr.name == "POSITION":
                column, kind = F.lit(0).cast("bigint"), k.INTEGER
                numbered.append(name)
            else:
                column, kind = self.ex.scalar(t.expr, scope)
                if kind.name == "structured":
                    raise self.fail("An object cannot be selected; select its members.", t)
                if kind.name == "unknown":
                    column = column.cast("string")
            columns.append(column.alias(name))
            fields.append((output_name(t), name, kind))
            if t.alias is not None:
                by_alias[t.alias] = (column, kind)
        keys = []
        for o in order:
            if isinstance(o.expr, n.Name) and len(o.expr.parts) == 1 and o.expr.parts[0] in by_alias and dict((a, c) for a, c, _ in fields)[o.expr.parts[0]] in numbered:
                raise self.fail("A query cannot be ordered by POSITION().", o)
            column, kind = self.ex.scalar(o.expr, scope.with_(bound={**by_alias}))
            keys.append((column, fresh("k"), o.descending))
        df = df.select(*columns, *(c.alias(name) for c, name, _ in keys), *base.places())
        typed = tuple(Field(a, c, kind, df.schema[c].dataType) for a, c, kind in fields)
        return Stage(df, typed, tuple((name, down) for _, name, down in keys), base.order, base.plain, tuple(numbered), base.open)

    def grouped(self, select: n.Select, base: Relation, scope: Scope, terms: Sequence[n.Term], order: Sequence[n.Order], aliases: Mapping[str, n.Node], facet: str | None = None) -> Stage:
        """``facet``: a column that all groups are formed within."""
        base = base.placed()
        if not base.plain:  # a sorted relation: its order as one ordinal
            o = fresh("o")
            base = Relation(base.sorted().withColumn(o, F.monotonically_increasing_id()), base.fields, ((o, False),), True)
        keys = []
        for g in select.group:
            if has_aggregate(g):
                raise self.fail("GROUP BY cannot contain aggregates.", g)
            column, kind = self.ex.scalar(g, scope)
            keys.append((g, column, kind, fresh("g")))
        wanted: dict[n.Aggregate, None] = {}
        for node in walk((tuple(t.expr for t in terms), select.having, tuple(o.expr for o in order))):
            if isinstance(node, n.Aggregate):
                if has_aggregate((node.arg, node.where)):
                    raise self.fail("Aggregates cannot be nested.", node)
                wanted[node] = None
        aggregates, computed = {}, []
        for a in wanted:
            column, kind = self.aggregate(a, scope)
            name = fresh("a")
            computed.append(column.alias(name))
            aggregates[a] = (F.col(name), kind)
        extra: list[Column] = []
        at = F.struct(*(c for c, _ in base.order))

        def first_row(c: Column) -> Column:
            name = fresh("f")
            extra.append(F.min_by(c, at).alias(name))
            return F.col(name)

        groups = [(g, repr(column), (F.col(name), kind)) for g, column, kind, name in keys]
        inner = scope.with_(groups=groups, aggregates=aggregates, aliases=dict(aliases), first_row=first_row)
        fields, columns = [], []
        for t in terms:
            if isinstance(t.expr, n.Call) and t.expr.name == "POSITION":
                column, kind = F.lit(0).cast("bigint"), k.INTEGER
            else:
                column, kind = self.ex.scalar(t.expr, inner.with_(aliases={}))
            name = fresh("c")
            columns.append((column.cast("string") if kind.name == "unknown" else column).alias(name))
            fields.append((output_name(t), name, kind, isinstance(t.expr, n.Call) and t.expr.name == "POSITION"))
        having = None if select.having is None else self.ex.predicate(select.having, inner)
        sort = [(self.ex.scalar(o.expr, inner)[0], fresh("k"), o.descending) for o in order]
        ord_ = [c for c, _ in base.order]
        wanted_first = first_of(ord_).alias("_first")
        within = [facet] if facet else []
        df = base.df.groupBy(*within, *(c.alias(name) for _, c, _, name in keys)).agg(wanted_first, *computed, *extra) if keys else base.df.agg(wanted_first, *computed, *extra)
        # Sorted by all of its keys, a group has no equals, and needs no place.
        by = {repr(c) for c, _, _ in sort}
        settled = bool(sort) and not facet and all(repr(F.col(name)) in by for _, _, _, name in keys)
        if having is not None:
            df = df.filter(having)
        df = df.select(*columns, *(c.alias(name) for c, name, _ in sort), *([] if settled else places_of("_first", ord_)))
        typed = tuple(Field(a, c, kind, df.schema[c].dataType) for a, c, kind, _ in fields)
        return Stage(df, typed, tuple((name, down) for _, name, down in sort), () if settled else base.order, True, tuple(c for _, c, _, p in fields if p))

    def aggregate(self, a: n.Aggregate, scope: Scope) -> tuple[Column, k.Kind]:
        kept = (lambda c: c) if a.where is None else (lambda c, p=self.ex.predicate(a.where, scope): F.when(p, c))
        if a.arg is None:
            return F.count(kept(F.lit(1))), k.INTEGER
        c, kind = self.ex.scalar(a.arg, scope)
        if a.name == "COUNT":
            return F.count(kept(c)), k.INTEGER
        if a.name in ("SUM", "AVG"):
            if not (kind.numeric or kind.name == "unknown"):
                raise self.fail(f"{a.name} requires numbers, not {kind.name}.", a)
            if a.name == "AVG":
                return F.avg(kept(c).cast("double")), k.NUMBER
            return (F.sum(kept(c)) if kind.name == "number" else F.try_sum(kept(c).cast("bigint"))), kind if kind.numeric else k.INTEGER
        if kind.name in ("collection", "structured"):
            raise self.fail(f"{a.name} requires a scalar.", a)
        return (F.min if a.name == "MIN" else F.max)(kept(c)), kind


def _alias(source: n.Source | None) -> str | None:
    return None if source is None else source.alias


def _conjuncts(node: n.Node) -> list[n.Node]:
    return [*_conjuncts(node.left), *_conjuncts(node.right)] if isinstance(node, n.Logic) and node.op == "AND" else [node]


def _starred(fields: Sequence[Field]) -> list[Field]:
    """Known fields in their order, then the others by name; collections and objects are left out."""
    scalars = [f for f in fields if f.kind.name not in ("collection", "structured")]
    known = {name: i for i, name in enumerate(k.KNOWN)}
    return sorted((f for f in scalars if f.name in known), key=lambda f: known[f.name]) + sorted((f for f in scalars if f.name not in known), key=lambda f: f.name.casefold())


def _all_nodes(query: n.Query):
    """All expressions of a query, those of inner queries too."""
    for b in query.branches:
        if isinstance(b, n.Query):
            yield from _all_nodes(b)
            continue
        yield from walk((tuple(b.terms or ()), b.where, b.group, b.having, b.join.on if b.join else None))
        for s in (b.source, b.join.right if b.join else None):
            if s is not None and s.query is not None:
                yield from _all_nodes(s.query)
    yield from walk(query.order)


def output_name(term: n.Term) -> str:
    """The alias, the field's own name, or the text of the expression."""
    if term.alias is not None:
        return term.alias
    return term.expr.parts[-1] if isinstance(term.expr, n.Name) else expression_text(term.expr)
