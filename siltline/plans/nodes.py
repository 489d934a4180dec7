"""The parts of a parsed query."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    """``at`` is the place in the text; it does not count in comparisons."""

    at: int = field(default=0, compare=False, kw_only=True)


# Scalar expressions


@dataclass(frozen=True)
class Name(Node):
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Literal(Node):
    """A literal in scalar position: str, int, float, bool or None. ``text`` keeps the base of a number."""

    value: object
    text: str = field(default="", compare=False)


@dataclass(frozen=True)
class Value(Node):
    """A literal beside a field; its meaning depends on the field's kind."""

    text: str
    quoted: bool
    constant: object = None  # True, False, or NULL as the string 'null'


@dataclass(frozen=True)
class Temporal(Node):
    """A dated literal in scalar position."""

    text: str
    shape: str


@dataclass(frozen=True)
class Sign(Node):
    op: str
    arg: Node


@dataclass(frozen=True)
class Arithmetic(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Aggregate(Node):
    name: str
    arg: Node | None  # None is COUNT(*)
    where: Node | None = None


@dataclass(frozen=True)
class Case(Node):
    whens: tuple[tuple[Node, Node], ...]
    otherwise: Node | None


@dataclass(frozen=True)
class Element(Node):
    base: Node
    place: Node


@dataclass(frozen=True)
class Member(Node):
    base: Node
    name: str


@dataclass(frozen=True)
class Collection(Node):
    """ANY, ALL, COUNT, FILTER (body is a predicate) or MAP (body is a scalar) over a collection."""

    op: str
    source: Node
    variable: str
    body: Node


# Predicates


@dataclass(frozen=True)
class Compare(Node):
    """Two scalars; also IS [NOT] DISTINCT FROM."""

    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class CompareField(Node):
    op: str
    field: Name
    value: Value


@dataclass(frozen=True)
class Between(Node):
    field: Name
    low: Value
    high: Value
    negated: bool


@dataclass(frozen=True)
class In(Node):
    field: Name
    values: tuple[Value, ...]
    negated: bool


@dataclass(frozen=True)
class IsNull(Node):
    arg: Node
    negated: bool


@dataclass(frozen=True)
class Truth(Node):
    predicate: Node
    value: str
    negated: bool


@dataclass(frozen=True)
class Text(Node):
    op: str
    field: Name
    pattern: str
    negated: bool


@dataclass(frozen=True)
class Flag(Node):
    """A scalar that is a truth value by itself."""

    arg: Node


@dataclass(frozen=True)
class Not(Node):
    arg: Node


@dataclass(frozen=True)
class Logic(Node):
    op: str
    left: Node
    right: Node


# Queries


@dataclass(frozen=True)
class Term(Node):
    """expr is a scalar; or it is None and ``star`` names the relation of a wildcard ('' for all)."""

    expr: Node | None
    alias: str | None = None
    star: str | None = None


@dataclass(frozen=True)
class Order(Node):
    expr: Node
    descending: bool = False


@dataclass(frozen=True)
class Source(Node):
    """A named relation with facets, or a derived one."""

    name: str | None
    facets: tuple[str, ...] = ()
    query: Query | None = None
    alias: str | None = None
    quoted: bool = False


@dataclass(frozen=True)
class Join(Node):
    kind: str
    right: Source
    on: Node


@dataclass(frozen=True)
class Select(Node):
    terms: tuple[Term, ...] | None  # None: the default projection
    distinct: bool = False
    source: Source | None = None
    join: Join | None = None
    where: Node | None = None
    group: tuple[Node, ...] = ()
    having: Node | None = None


@dataclass(frozen=True)
class Query(Node):
    """Branches joined by UNION (all: with copies); ORDER BY, LIMIT and OFFSET of the whole."""

    branches: tuple[Select | Query, ...]
    alls: tuple[bool, ...] = ()
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int | None = None
    ctes: tuple[tuple[str, Query], ...] = ()
    limit_text: str = field(default="", compare=False)
    offset_text: str = field(default="", compare=False)
