"""Objects that outlive one task in a Python worker, such as loaded vocabularies and caches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator


def once(key: tuple, make: Callable[[], object]) -> object:
    """``make()``'s result, made once per worker process and key."""
    held = sys.modules.setdefault("_cuesheet_worker", types.ModuleType("_cuesheet_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


class Units(dict):
    """A bounded cache from a text unit to what encoding it gives; starts anew when it is full.

    ``encode`` takes a list of units.  A value of False says that the unit can't be encoded alone.
    """

    def __init__(self, encode: Callable[[list[str]], list], most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def look_up(self, texts: list[list[str]]) -> list[list]:
        """The values of every unit of every text; units not met before are encoded together."""
        get = self.get
        found = [list(map(get, units)) for units in texts]
        new = {}
        for values, units in zip(found, texts):
            if None in values:
                new.update(dict.fromkeys([u for u, v in zip(units, values) if v is None]))
        if new:
            if len(self) + len(new) > self.most:
                self.clear()
            fresh = dict(zip(new, self.encode(list(new))))
            self.update(fresh)
            for values, units in zip(found, texts):
                if None in values:
                    values[:] = [fresh[u] if v is None else v for u, v in zip(units, values)]
        return found


def groups(texts: list[str], most: int = 1 << 19) -> Iterator[list[str]]:
    """Consecutive texts, of about ``most`` characters together."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group
