"""Units of time, read from data."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path


@dataclass(frozen=True)
class Unit:
    """``amount`` seconds, or calendar months if ``calendar``."""

    name: str
    amount: float
    calendar: bool


class Units:
    """A registry of units; every name and other spelling is unique, regardless of case."""

    def __init__(self, definitions: Mapping[str, Mapping]) -> None:
        self._names: dict[str, str] = {}
        for name, d in definitions.items():
            for spelling in (name, *d.get("also", ())):
                if self._names.setdefault(spelling.casefold(), name) != name or (spelling != name and spelling.casefold() == name.casefold()):
                    raise ValueError(f"unit {spelling!r} is defined twice")
        self._units: dict[str, Unit] = {}
        for name in definitions:
            self._resolve(name, definitions, ())

    def _resolve(self, name: str, definitions: Mapping[str, Mapping], above: tuple[str, ...]) -> Unit:
        if name in above:
            raise ValueError(f"unit {name!r} is defined by itself")
        if name not in definitions:
            raise ValueError(f"unknown unit {name!r}")
        if name not in self._units:
            d = definitions[name]
            if "times" in d:
                count, base = d["times"]
                if not count > 0:
                    raise ValueError(f"unit {name!r} needs a positive amount")
                of = self._resolve(base, definitions, (*above, name))
                self._units[name] = Unit(name, count * of.amount, of.calendar)
            else:
                self._units[name] = Unit(name, d["months"] if "months" in d else d["seconds"], "months" in d)
        return self._units[name]

    def find(self, spelling: str) -> Unit | None:
        name = self._names.get(spelling.casefold())
        return None if name is None else self._units[name]


@lru_cache(maxsize=1)
def default_units() -> Units:
    """The units of the JSON file beside this module."""
    return Units(json.loads(Path(__file__).with_name("units.json").read_text(encoding="utf-8")))
