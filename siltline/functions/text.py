"""Text helpers that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters with the Unicode property White_Space (fixed values).
WHITE_SPACE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip_white_space(column: str | Column) -> Column:
    """The text without white space of any Unicode kind at its ends; null stays null."""
    return F.btrim(F.col(column) if isinstance(column, str) else column, F.lit(WHITE_SPACE))


#: Stands for the dotless i while text is folded, so that it does not meet the dotted one.
_DOTLESS = "\ue131"


def casefold(column: Column) -> Column:
    """Full case folding, without leaving the JVM.

    ASCII text (as many bytes as characters) is only lowered. For other text, upper and then lower case fold like Unicode's full folding but for two letters, which are mapped before,
    and the sigma, which is lowered by itself: Java's lower case knows a final form and folding does not. (That
    also keeps the optimiser from dropping the upper case below the lower.)
    """
    whole = F.lower(F.translate(F.upper(F.translate(column, "ẞı", "ß" + _DOTLESS)), "Σ", "σ"))
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(whole)


def java_pattern(pattern: str) -> str | None:
    """A Python regular expression as a Java one that finds the same, or None if there is none.

    Java gets Unicode classes and Python's idea of lines; group names, absolute anchors and brackets within
    classes are spelled its way. What only Python has (conditions, scoped flags in the middle, look-behind,
    whose limits differ) is not translated.
    """
    out, i, inside = [], 0, False
    while i < len(pattern):
        c, rest = pattern[i], pattern[i:]
        if c == "\\":
            nxt = pattern[i + 1 : i + 2]
            if nxt == "Z" and not inside:
                out.append(r"\z")
            elif nxt in "AbBdDsSwWnrtfvax0123456789uU" or not nxt.isalnum():
                if nxt in "v":
                    out.append(r"\x0B")
                elif nxt in "xuU0123456789" and (nxt in "U0" or inside and nxt.isdigit()):
                    return None
                else:
                    out.append(c + nxt)
            else:
                return None
            i += 2
            continue
        if inside:
            if c == "]" and not first:
                inside = False
            out.append("\\[" if c == "[" else "\\&" if c == "&" else "\\]" if c == "]" and first else c)
            first = first and c == "^" and out[-2:-1] == ["["]
        elif c == "[":
            inside = first = True
            out.append(c)
        elif rest.startswith("(?P<"):
            name = rest[4:].partition(">")[0]
            if not name.isascii() or not name.isalnum():
                return None
            out.append("(?<")
            i += 3
        elif rest.startswith("(?P="):
            name, _, _ = rest[4:].partition(")")
            out.append(f"\\k<{name}>")
            i += 5 + len(name)
            continue
        elif rest.startswith("(?") and not rest.startswith(("(?:", "(?=", "(?!", "(?>")):
            return None
        else:
            out.append(c)
        i += 1
    return "(?Ud)" + "".join(out)


def like_as_java(pattern: str) -> str:
    """A LIKE pattern as a Java expression for the whole text, regardless of case."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            c = pattern[i]
            out.append("\\Q" + c + "\\E" if c != "\\" else "\\\\")
        else:
            out.append(".*" if c == "%" else "." if c == "_" else "\\" + c if not c.isalnum() and c.isascii() else c)
        i += 1
    return "(?ius)\\A" + "".join(out) + "\\z"


def matches(column: Column, pattern: str) -> Column:
    """Is the pattern found in the text? In the JVM where Java has the pattern, else by batches in Python."""
    java = java_pattern(pattern)
    if java is not None:
        return column.rlike(java)

    @F.arrow_udf("boolean")
    def search(values):
        import re

        import pyarrow as pa

        found = re.compile(pattern)
        return pa.array([None if v is None else found.search(v) is not None for v in values.to_pylist()], pa.bool_())

    return search(column)
