"""Which tables belong to a city."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class City:
    city_id: str
    stations: str | None = None
    incidents: str | None = None
    notes: dict = field(default_factory=dict)

    def required(self, *names: str) -> City:
        """Itself, if it has these paths; else an error that names what is missing."""
        missing = [n for n in names if not getattr(self, n)]
        if missing:
            raise FileNotFoundError(f"{self.city_id} has no {', '.join(missing)}")
        return self


def city_key(name: str) -> str:
    """The id of a name, whatever its case, blanks and hyphens."""
    return re.sub(r"[\s\-]+", "_", name.strip().lower())


class Registry:
    def __init__(self) -> None:
        self._known: dict[str, City] = {}

    def add(self, city: City) -> None:
        self._known[city_key(city.city_id)] = city

    def get(self, name: str, **paths: str) -> City:
        """The city of a name with paths put in the place of its own; "custom" needs its paths given."""
        key = city_key(name)
        base = City("custom") if key == "custom" else self._known.get(key)
        if base is None:
            raise KeyError(f"unknown city {name!r}; known: {sorted(self._known)}")
        return replace(base, **{k: os.fspath(v) for k, v in paths.items() if v})
