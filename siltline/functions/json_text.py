"""JSON texts of any depth. What the standard reader and writer can hold on the stack they do; deeper texts go through loops."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from json.encoder import encode_basestring

_BLANK = " \t\n\r"
_ATOM = re.compile(r"true|false|null|-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?", re.ASCII)
_WORDS = {"true": True, "false": False, "null": None}


def _refused(name: str):
    raise ValueError(f"{name} is not JSON")


def read_json(text: str) -> object:
    """The value of a text; ValueError where it is not one complete JSON value. NaN and Infinity are not JSON."""
    try:
        return json.loads(text, parse_constant=_refused)
    except RecursionError:
        return _read(text)


def _read(text: str) -> object:
    """Open lists and objects are kept on a list; ``name`` is the member that the next value belongs to."""
    open_: list = []
    names: list[str | None] = []
    at, whole = 0, len(text)

    def skip(i: int) -> int:
        while i < whole and text[i] in _BLANK:
            i += 1
        return i

    def member(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError(f"a name is missing at {i}")
        name, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(f"a colon is missing at {i}")
        return name, i + 1

    while True:
        at = skip(at)
        c = text[at : at + 1]
        if c in ("[", "{") and c:
            value: object = [] if c == "[" else {}
            at = skip(at + 1)
            if text[at : at + 1] != ("]" if c == "[" else "}"):
                name, at = member(at) if c == "{" else (None, at)
                open_.append(value)
                names.append(name)
                continue
            at += 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif found := _ATOM.match(text, at):
            word = found[0]
            value = _WORDS[word] if word in _WORDS else float(word) if found[1] or found[2] else int(word)
            at = found.end()
        else:
            raise ValueError(f"no value at {at}")
        while True:  # the value goes into what is open; what it completes is a value in turn
            if not open_:
                if skip(at) != whole:
                    raise ValueError(f"something follows at {at}")
                return value
            inside = open_[-1]
            if isinstance(inside, list):
                inside.append(value)
            else:
                inside[names[-1]] = value
            at = skip(at)
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                if isinstance(inside, dict):
                    names[-1], at = member(at)
                break
            if c != ("]" if isinstance(inside, list) else "}"):
                raise ValueError(f"a list or object is not closed at {at}")
            at += 1
            value = open_.pop()
            names.pop()


def write_json(value: object) -> str:
    """The value as JSON, other alphabets as they are."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return "".join(_written(value))


def _written(value: object):
    """Texts to write and values to be written wait on a list, the next one last; texts are marked by a pair."""
    waiting: list = [value]
    while waiting:
        x = waiting.pop()
        if isinstance(x, tuple):
            yield x[0]
        elif isinstance(x, list):
            waiting.append(("]",))
            for i in range(len(x) - 1, -1, -1):
                waiting.append(x[i])
                if i:
                    waiting.append((", ",))
            yield "["
        elif isinstance(x, dict):
            waiting.append(("}",))
            for i, (name, inner) in reversed(list(enumerate(x.items()))):
                waiting.append(inner)
                waiting.append(((", " if i else "") + encode_basestring(name) + ": ",))
            yield "{"
        else:
            yield json.dumps(x, ensure_ascii=False)


def depth_bound(text: str) -> int:
    """A number of levels that the value of a text cannot exceed."""
    return text.count("[") + text.count("{")
