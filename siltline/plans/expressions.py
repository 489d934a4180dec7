"""Scalars and predicates of a query as Spark columns."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, fields, is_dataclass
from datetime import date, datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltline.functions import kinds as k
from siltline.functions import literals
from siltline.functions.kinds import Kind
from siltline.functions.literals import Clock, Infinity
from siltline.functions.text import casefold, like_as_java, matches
from siltline.plans import nodes as n
from siltline.plans.errors import SemanticError

Typed = tuple[Column, Kind]
_SPARK = {"string": "string", "integer": "bigint", "count": "bigint", "duration": "bigint", "number": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp"}
_LONG = 1 << 63


@dataclass(frozen=True)
class Field:
    """A field of a relation and the internal column that holds it."""

    name: str
    column: str
    kind: Kind
    type: T.DataType


@dataclass
class Scope:
    """What names mean: relations by alias, collection bindings, select aliases, and in groups what is known there."""

    relations: list[tuple[str | None, Sequence[Field]]]
    joined: bool = False
    bound: dict[str, Typed] = field(default_factory=dict)
    aliases: dict[str, n.Node] = field(default_factory=dict)
    groups: list[tuple[n.Node, str, Typed]] | None = None
    aggregates: dict[n.Aggregate, Typed] = field(default_factory=dict)
    first_row: Callable[[Column], Column] | None = None
    in_case: bool = False
    drawn: dict[int, Column] = field(default_factory=dict)  # RANDOM() by place in the text

    def with_(self, **changes) -> Scope:
        return Scope(**{f.name: changes.get(f.name, getattr(self, f.name)) for f in fields(self)})


def walk(node: object) -> Iterator[n.Node]:
    """The node and all nodes in it; queries inside are not entered."""
    if isinstance(node, tuple):
        for x in node:
            yield from walk(x)
    elif is_dataclass(node) and not isinstance(node, (n.Query, n.Select)):
        yield node
        for f in fields(node):
            yield from walk(getattr(node, f.name))


def has_aggregate(node: object) -> bool:
    return any(isinstance(x, n.Aggregate) for x in walk(node))


class Expressions:
    """Lowers expressions of one query. ``text`` is the query, for errors."""

    def __init__(self, text: str, clock: Clock) -> None:
        self.text, self.clock = text, clock

    def fail(self, message: str, node: n.Node) -> SemanticError:
        return SemanticError(self.text, message, node.at)

    # Names

    def name(self, node: n.Name, scope: Scope) -> Typed:
        parts = node.parts
        if parts[0] in scope.bound:
            return self.members(scope.bound[parts[0]], parts[1:], node)
        if scope.groups is not None:
            return self.grouped_name(node, scope)
        return self.field(node, scope)

    def grouped_name(self, node: n.Name, scope: Scope) -> Typed:
        plain = scope.with_(groups=None)
        if len(node.parts) == 1 and node.parts[0] in scope.aliases:
            return self.scalar(scope.aliases[node.parts[0]], scope.with_(aliases={}))
        found = self.field(node, plain)
        for _, key, typed in scope.groups:
            if key == repr(found[0]):
                return typed
        if scope.first_row and (scope.joined or scope.in_case):
            return scope.first_row(found[0]), found[1]
        raise self.fail(f"Field {'.'.join(node.parts)!r} must appear in GROUP BY or inside an aggregate.", node)

    def find(self, node: n.Name, scope: Scope) -> tuple[Field, tuple[str, ...]]:
        """The field that a name means, and the members behind it."""
        parts = node.parts
        where = [r for alias, r in scope.relations if alias is not None and alias == parts[0]] if len(parts) > 1 else []
        tries = [(where, parts[1:])] if where else []
        tries.append(([r for _, r in scope.relations], parts))
        for relations, names in tries:
            for length in range(len(names), 0, -1):
                wanted = ".".join(names[:length])
                hits = [f for r in relations for f in r if f.name == wanted]
                if not hits and wanted in k.ALIASES:
                    hits = [f for r in relations for f in r if f.name == k.ALIASES[wanted]]
                if len(hits) > 1:
                    raise self.fail(f"Field {wanted!r} is ambiguous; qualify it with a relation.", node)
                if hits:
                    return hits[0], names[length:]
        known = [f.name for _, r in scope.relations for f in r]
        close = difflib.get_close_matches(node.parts[-1], known, 1)
        raise self.fail(f"Unknown field {'.'.join(parts)!r}." + (f" Did you mean {close[0]!r}?" if close else ""), node)

    def field(self, node: n.Name, scope: Scope) -> Typed:
        found, rest = self.find(node, scope)
        return self.members((F.col(found.column), found.kind), rest, node)

    def members(self, base: Typed, names: Sequence[str], node: n.Node) -> Typed:
        column, kind = base
        for name in names:
            if kind.name != "structured" or name not in kind.members:
                raise self.fail(f"There is no member {name!r}.", node)
            column, kind = column.getField(name), kind.members[name]
            if kind.name == "number":
                column = column.cast("double")
            elif kind.numeric:
                column = column.cast("bigint")
        return column, kind

    # Scalars

    def scalar(self, node: n.Node, scope: Scope, hint: Kind | None = None) -> Typed:
        if scope.groups is not None and not isinstance(node, (n.Literal, n.Name)):
            for known, _, typed in scope.groups:
                if known == node:
                    return typed
        method = getattr(self, "_" + type(node).__name__.lower(), None)
        if method is None:
            raise self.fail("This is not a scalar expression.", node)
        return method(node, scope, hint)

    def _name(self, node: n.Name, scope: Scope, hint: Kind | None) -> Typed:
        return self.name(node, scope)

    def _literal(self, node: n.Literal, scope: Scope, hint: Kind | None) -> Typed:
        value = node.value
        if value is None:
            return F.lit(None), k.UNKNOWN
        if isinstance(value, bool):
            return F.lit(value), k.BOOLEAN
        if isinstance(value, int):
            if not -_LONG <= value < _LONG:
                raise self.fail("The number does not fit into 64 bits.", node)
            return F.lit(value).cast("bigint"), k.INTEGER
        if isinstance(value, float):
            return F.lit(value), k.NUMBER
        if hint is not None and hint.name in ("date", "datetime"):
            return self.constant(self.meaning(str(value), True, hint, node), hint), hint
        return F.lit(value), k.STRING

    def _temporal(self, node: n.Temporal, scope: Scope, hint: Kind | None) -> Typed:
        by_shape = {"date": k.DATE, "datetime": k.DATETIME, "time": k.DURATION, "duration": k.DURATION, "count": k.COUNT, "m": k.DURATION, "temporal": k.DATE if node.text[:1].upper() == "T" else k.DATETIME}
        kind = hint if hint is not None and hint.name in ("date", "datetime", "duration", "count") else by_shape.get(node.shape)
        if kind is None:
            raise self.fail("INFINITY() needs a date or a timestamp beside it.", node)
        return self.constant(self.meaning(node.text, False, kind, node), kind), kind

    def meaning(self, text: str, quoted: bool, kind: Kind, node: n.Node) -> object:
        try:
            return literals.by_kind(text, quoted, kind.name, self.clock)
        except (ValueError, OverflowError) as e:
            raise self.fail(str(e), node) from e

    def constant(self, value: object, kind: Kind) -> Column:
        if isinstance(value, datetime):
            utc = value.astimezone(timezone.utc)
            return F.expr(f"timestamp_ntz'{utc:%Y-%m-%d %H:%M:%S.%f}'" if kind.naive else f"timestamp'{utc:%Y-%m-%d %H:%M:%S.%f}+00:00'")
        if isinstance(value, date):
            return F.lit(value)
        if isinstance(value, int) and not isinstance(value, bool):
            return F.lit(value).cast("double" if kind.name == "number" else "bigint")
        return F.lit(value)

    def numbers(self, args: Sequence[n.Node], scope: Scope, what: str) -> tuple[list[Column], bool]:
        """Numeric arguments, all bigint or all double; are they doubles?"""
        typed = [self.scalar(a, scope) for a in args]
        for (_, kind), a in zip(typed, args):
            if not (kind.numeric or kind.name in ("unknown", "mixed")):
                raise self.fail(f"{what} requires numbers, not {kind.name}.", a)
        double = any(kind.name == "number" for _, kind in typed)
        return [c.cast("double" if double else "bigint") for c, _ in typed], double

    def _sign(self, node: n.Sign, scope: Scope, hint: Kind | None) -> Typed:
        (c,), double = self.numbers([node.arg], scope, "A sign")
        return (c if node.op == "+" else F.try_subtract(F.lit(0).cast("double" if double else "bigint"), c) if not double else -c), k.NUMBER if double else k.INTEGER

    def _arithmetic(self, node: n.Arithmetic, scope: Scope, hint: Kind | None) -> Typed:
        (a, b), double = self.numbers([node.left, node.right], scope, f"'{node.op}'")
        kind = k.NUMBER if double else k.INTEGER
        if node.op == "/":
            return F.try_divide(a.cast("double"), b.cast("double")), k.NUMBER
        if node.op == "%":
            return F.try_mod(F.try_add(F.try_mod(a, b), b), b), kind
        return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[node.op](a, b), kind

    def _element(self, node: n.Element, scope: Scope, hint: Kind | None) -> Typed:
        base, kind = self.scalar(node.base, scope)
        if kind.name != "collection":
            raise self.fail("Only a collection can be indexed.", node)
        if not kind.ordered:
            raise self.fail("The collection has no stable order and cannot be indexed.", node)
        place = node.place
        if isinstance(place, n.Sign) and place.op == "-" and isinstance(place.arg, n.Literal):
            raise self.fail("An index must not be negative.", place)
        at, at_kind = self.scalar(place, scope)
        if at_kind.name not in ("integer", "count", "duration", "unknown"):
            raise self.fail("An index must be a whole number.", place)
        inside = F.when((at >= 0) & (at < (1 << 31) - 1), at).cast("int")
        return self.members((F.get(base, inside), kind.element), (), node)

    def _member(self, node: n.Member, scope: Scope, hint: Kind | None) -> Typed:
        return self.members(self.scalar(node.base, scope), (node.name,), node)

    def _case(self, node: n.Case, scope: Scope, hint: Kind | None) -> Typed:
        inner = scope.with_(in_case=True)
        results = [self.scalar(x, scope) for _, x in node.whens]
        if node.otherwise is not None:
            results.append(self.scalar(node.otherwise, scope))
        columns, kind = self.unified(results, node, "CASE")
        out = F
        for (condition, _), c in zip(node.whens, columns):
            out = out.when(self.predicate(condition, inner), c)
        return (out.otherwise(columns[-1]) if node.otherwise is not None else out), kind

    def unified(self, typed: Sequence[Typed], node: n.Node, what: str) -> tuple[list[Column], Kind]:
        """Values of one common kind."""
        kind = k.UNKNOWN
        for _, other in typed:
            found = k.common(kind, other)
            if found is None:
                raise self.fail(f"{what} mixes {kind.name} and {other.name}.", node)
            kind = found
        to = _SPARK.get(kind.name)
        if to == "timestamp" or to is None:
            return [c for c, _ in typed], kind
        return [c if own == kind and own.name != "integer" else c.cast(to) for c, own in typed], kind

    def _call(self, node: n.Call, scope: Scope, hint: Kind | None) -> Typed:
        return getattr(self, "_fn_" + node.name.lower())(node, scope)

    def texts(self, node: n.Call, scope: Scope) -> list[Column]:
        out = []
        for a in node.args:
            c, kind = self.scalar(a, scope)
            if kind.name not in ("string", "unknown", "mixed"):
                raise self.fail(f"{node.name} requires text, not {kind.name}.", a)
            out.append(c.cast("string"))
        return out

    def _fn_lower(self, node: n.Call, scope: Scope) -> Typed:
        return F.lower(self.texts(node, scope)[0]), k.STRING

    def _fn_upper(self, node: n.Call, scope: Scope) -> Typed:
        return F.upper(self.texts(node, scope)[0]), k.STRING

    def _fn_length(self, node: n.Call, scope: Scope) -> Typed:
        return F.char_length(self.texts(node, scope)[0]).cast("bigint"), k.INTEGER

    def _fn_concat(self, node: n.Call, scope: Scope) -> Typed:
        return F.concat(*self.texts(node, scope)), k.STRING

    def _fn_char(self, node: n.Call, scope: Scope) -> Typed:
        for a in node.args:
            if isinstance(a, n.Literal) and isinstance(a.value, int) and not (0 <= a.value <= 0x10FFFF and not 0xD800 <= a.value <= 0xDFFF):
                raise self.fail("CHAR code points must be Unicode scalar values.", a)
        codes, double = self.numbers(node.args, scope, "CHAR")
        out = []
        for c in codes:
            whole = F.when(c == F.floor(c), c).cast("bigint") if double else c
            valid = whole.between(0, 0xD7FF) | whole.between(0xE000, 0x10FFFF)
            out.append(F.when(valid, F.decode(F.unhex(F.lpad(F.hex(whole), 8, "0")), "UTF-32")))
        return F.concat(*out), k.STRING

    def _fn_coalesce(self, node: n.Call, scope: Scope) -> Typed:
        columns, kind = self.unified([self.scalar(a, scope) for a in node.args], node, "COALESCE")
        return F.coalesce(*columns), kind

    def _extreme(self, node: n.Call, scope: Scope, pick: Callable[..., Column]) -> Typed:
        columns, kind = self.unified([self.scalar(a, scope) for a in node.args], node, node.name)
        known = columns[0].isNotNull()
        for c in columns[1:]:
            known &= c.isNotNull()
        return F.when(known, pick(*columns)), kind

    def _fn_greatest(self, node: n.Call, scope: Scope) -> Typed:
        return self._extreme(node, scope, F.greatest)

    def _fn_least(self, node: n.Call, scope: Scope) -> Typed:
        return self._extreme(node, scope, F.least)

    def _fn_nullif(self, node: n.Call, scope: Scope) -> Typed:
        a = self.scalar(node.args[0], scope)
        (x, y), _ = self.unified([a, self.scalar(node.args[1], scope, a[1])], node, "NULLIF")
        return F.when(F.coalesce(x == y, F.lit(False)), F.lit(None)).otherwise(a[0]), a[1]

    def _fn_cardinality(self, node: n.Call, scope: Scope) -> Typed:
        c, kind = self.scalar(node.args[0], scope)
        if kind.name != "collection":
            raise self.fail("CARDINALITY requires a collection.", node)
        return F.array_size(c).cast("bigint"), k.INTEGER

    def _fn_random(self, node: n.Call, scope: Scope) -> Typed:
        if not node.args:
            if node.at not in scope.drawn:
                raise self.fail("RANDOM() is not allowed here.", node)
            return scope.drawn[node.at], k.NUMBER
        seed = node.args[0]
        if not isinstance(seed, n.Literal) or not isinstance(seed.value, int) or isinstance(seed.value, bool):
            raise self.fail("The seed of RANDOM must be a constant whole number.", node)
        known = [f for _, r in scope.relations for f in r]
        identity = [f for f in known if f.name in ("extractor", "extractor_key", "webpage_url", "url", "id")] or known
        # 52 bits of a digest of the seed and the row's identity; a separator that no name has stands before each part.
        parts = [F.concat(F.lit(f"\x1f{f.name}="), F.coalesce(F.col(f.column).cast("string"), F.lit("\x1e"))) for f in identity]
        bits = F.conv(F.substring(F.sha2(F.concat(F.lit(str(seed.value)), *parts), 256), 1, 13), 16, 10)
        return bits.cast("double") / F.lit(float(1 << 52)), k.NUMBER

    def _fn_position(self, node: n.Call, scope: Scope) -> Typed:
        raise self.fail("POSITION() may only stand alone as a select term.", node)

    def _aggregate(self, node: n.Aggregate, scope: Scope, hint: Kind | None) -> Typed:
        if node not in scope.aggregates:
            raise self.fail(f"{node.name} is not allowed here.", node)
        return scope.aggregates[node]

    def _collection(self, node: n.Collection, scope: Scope, hint: Kind | None) -> Typed:
        if node.op in ("ANY", "ALL"):
            raise self.fail(f"{node.op} is a predicate.", node)
        c, kind = self.collection_source(node, scope)
        if node.op == "MAP":
            seen: list[Kind] = []

            def item(x: Column) -> Column:
                out, of = self.scalar(node.body, scope.with_(bound={**scope.bound, node.variable: (x, kind.element)}))
                seen.append(of)
                return out

            if has_aggregate(node.body):
                raise self.fail("MAP cannot contain aggregates.", node)
            out = F.transform(c, item)
            return out, Kind("collection", seen[-1], ordered=kind.ordered)
        kept = F.filter(c, self.test(node, scope, kind))
        return (kept, kind) if node.op == "FILTER" else (F.array_size(kept).cast("bigint"), k.INTEGER)

    def collection_source(self, node: n.Collection, scope: Scope) -> Typed:
        c, kind = self.scalar(node.source, scope)
        if kind.name != "collection":
            raise self.fail(f"{node.op} requires a collection.", node)
        return c, kind

    def test(self, node: n.Collection, scope: Scope, kind: Kind) -> Callable[[Column], Column]:
        return lambda x: self.predicate(node.body, scope.with_(bound={**scope.bound, node.variable: (x, kind.element)}))

    # Predicates

    def predicate(self, node: n.Node, scope: Scope) -> Column:
        method = getattr(self, "_is_" + type(node).__name__.lower(), None)
        if method is None:
            raise self.fail("This is not a predicate.", node)
        return method(node, scope)

    def _is_logic(self, node: n.Logic, scope: Scope) -> Column:
        # A long chain is put together as a balanced tree, which keeps plans shallow.
        parts: list[n.Node] = []
        todo: list[n.Node] = [node]
        while todo:
            x = todo.pop()
            if isinstance(x, n.Logic) and x.op == node.op:
                todo += [x.right, x.left]
            else:
                parts.append(x)
        columns = [self.predicate(p, scope) for p in parts]
        while len(columns) > 1:
            paired = [columns[i] & columns[i + 1] if node.op == "AND" else columns[i] | columns[i + 1] for i in range(0, len(columns) - 1, 2)]
            columns = paired + ([columns[-1]] if len(columns) % 2 else [])
        return columns[0]

    def _is_not(self, node: n.Not, scope: Scope) -> Column:
        return ~self.predicate(node.arg, scope)

    def _is_flag(self, node: n.Flag, scope: Scope) -> Column:
        c, kind = self.scalar(node.arg, scope)
        if kind.name not in ("boolean", "unknown"):
            raise self.fail(f"A {kind.name} is not a truth value; compare it with something.", node)
        return c.cast("boolean")

    def _is_truth(self, node: n.Truth, scope: Scope) -> Column:
        p = self.predicate(node.predicate, scope)
        found = p.isNull() if node.value == "UNKNOWN" else F.coalesce(p if node.value == "TRUE" else ~p, F.lit(False))
        return ~found if node.negated else found

    def _is_isnull(self, node: n.IsNull, scope: Scope) -> Column:
        c, _ = self.scalar(node.arg, scope)
        return c.isNotNull() if node.negated else c.isNull()

    def _is_compare(self, node: n.Compare, scope: Scope) -> Column:
        a = self.scalar(node.left, scope)
        b = self.scalar(node.right, scope, a[1])
        if isinstance(node.left, (n.Literal, n.Temporal)):
            a = self.scalar(node.left, scope, b[1])
        if "mixed" in (a[1].name, b[1].name):
            a, b = ((c.cast("string"), k.STRING) for c, _ in (a, b))
        if k.common(a[1], b[1]) is None:
            if any(isinstance(x, n.Temporal) and x.shape == "infinity" for x in (node.left, node.right)):
                raise self.fail("INFINITY() needs a date or a timestamp beside it.", node)
            raise self.fail(f"Cannot compare {a[1].name} with {b[1].name}.", node)
        (x, y), _ = self.unified([a, b], node, "The comparison")
        return self.ordered(node.op, x, y)

    def ordered(self, op: str, x: Column, y: Column) -> Column:
        if op.endswith("DISTINCT FROM"):
            return x.eqNullSafe(y) if "NOT" in op else ~x.eqNullSafe(y)
        return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def left_field(self, node: n.Name, scope: Scope) -> tuple[Column, Kind, bool]:
        """A field beside literals, its kind, and whether case does not count."""
        c, kind = self.name(node, scope)
        if kind.name in ("structured", "collection"):
            raise self.fail(f"Field {'.'.join(node.parts)!r} is an object or collection and cannot be used as a scalar value.", node)
        return c, kind, kind.name == "string" and node.parts[-1] in k.CASELESS

    def operand(self, c: Column, kind: Kind, caseless: bool, value: n.Value) -> object:
        """The literal as a column; an Infinity stays one; NULL is None."""
        if value.constant == "null":
            return None
        if value.constant is not None and kind.name not in ("boolean", "mixed", "unknown"):
            raise self.fail(f"Cannot compare {kind.name} with a truth value.", value)
        found = value.constant if value.constant is not None else self.meaning(value.text, value.quoted, kind, value)
        if isinstance(found, Infinity):
            return found
        if kind.name in ("mixed", "unknown"):
            return F.lit(str(found))
        return F.lit(str(found).casefold()) if caseless else self.constant(found, kind)

    def against(self, op: str, c: Column, other: object) -> Column:
        if isinstance(other, Infinity):
            holds = op == "!=" or op in (("<", "<=") if other.positive else (">", ">="))
            return F.when(c.isNotNull(), F.lit(holds))
        return self.ordered(op, c, other)

    def _is_comparefield(self, node: n.CompareField, scope: Scope) -> Column:
        c, kind, caseless = self.left_field(node.field, scope)
        other = self.operand(c, kind, caseless, node.value)
        if other is None:
            raise self.fail("Use IS NULL or IS NOT NULL to test for NULL.", node)
        return self.against(node.op, F.lower(c) if caseless else c, other)

    def _is_between(self, node: n.Between, scope: Scope) -> Column:
        c, kind, caseless = self.left_field(node.field, scope)
        low, high = (self.operand(c, kind, False, v) for v in (node.low, node.high))
        if low is None or high is None:
            found = F.when(c.isNotNull(), F.lit(False))
        else:
            found = self.against(">=", c, low) & self.against("<=", c, high)
        return ~found if node.negated else found

    def _is_in(self, node: n.In, scope: Scope) -> Column:
        c, kind, caseless = self.left_field(node.field, scope)
        members = [x for v in node.values if (x := self.operand(c, kind, caseless, v)) is not None and not isinstance(x, Infinity)]
        found = (F.lower(c) if caseless else c).isin(members) if members else F.when(c.isNotNull(), F.lit(False))
        return ~found if node.negated else found

    def _is_text(self, node: n.Text, scope: Scope) -> Column:
        c, kind = self.name(node.field, scope)
        if kind.name not in ("string", "mixed", "unknown"):
            raise self.fail(f"{node.op} requires a text field.", node)
        c = c.cast("string")
        if node.op == "CONTAINS":
            found = F.contains(casefold(c), casefold(F.lit(node.pattern)))
        elif node.op == "MATCHES":
            found = matches(c, node.pattern)
        elif node.op == "LIKE":
            found = c.like(_spark_like(node.pattern))
        else:
            found = c.rlike(like_as_java(node.pattern))
        return ~found if node.negated else found

    def _is_collection(self, node: n.Collection, scope: Scope) -> Column:
        if node.op not in ("ANY", "ALL"):
            raise self.fail(f"{node.op} is not a predicate.", node)
        c, kind = self.collection_source(node, scope)
        return (F.exists if node.op == "ANY" else F.forall)(c, self.test(node, scope, kind))


def _spark_like(pattern: str) -> str:
    """Spark allows a backslash only before a wildcard or another backslash."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
            out.append("\\" + pattern[i] if pattern[i] in "%_\\" else pattern[i])
        else:
            out.append(pattern[i])
        i += 1
    return "".join(out)
