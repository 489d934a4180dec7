"""Errors of the query language; each knows the place in the text."""

from __future__ import annotations


class QueryError(ValueError):
    """A query that cannot be run. ``start`` and ``end`` are the half-open span in ``text``."""

    def __init__(self, text: str, message: str, start: int = 0, end: int | None = None) -> None:
        super().__init__(message)
        self.text, self.message = text, message
        self.start, self.end = start, start + 1 if end is None else end

    @property
    def line(self) -> int:
        return self.text.count("\n", 0, self.start) + 1

    @property
    def column(self) -> int:
        return self.start - (self.text.rfind("\n", 0, self.start) + 1) + 1

    def pretty(self) -> str:
        """The message, the line it is about, and a caret below the place."""
        line = (self.text.splitlines() or [""])[min(self.line, len(self.text.splitlines()) or 1) - 1]
        return f"{self.message}\nline {self.line}, column {self.column}\n{line}\n{' ' * (self.column - 1)}{'^' * max(1, min(self.end - self.start, len(line) - self.column + 1))}"


class LexicalError(QueryError):
    """The text has no such token."""


class SyntaxError_(QueryError):
    """The tokens make no query."""


class SemanticError(QueryError):
    """The query means nothing: unknown names, kinds that do not fit, values that do not exist."""
