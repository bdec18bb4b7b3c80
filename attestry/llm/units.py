"""Encoding by units: stretches of text whose ids do not depend on what stands around them, kept in a bounded cache."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from contextlib import suppress
from itertools import chain

#: Units in each of the cache's two generations, for each Python worker.
CACHE_UNITS = 700_000
#: A longer unit is encoded but not kept.
CACHE_CHARS = 64
#: Units that are looked up at a time, over as many texts.
JOINED = 200_000
ODD_SPACE = re.compile(r"[^\S \n]")


def units(text: str) -> list[str]:
    """A text in units: `w` stands for a blank and the word w, a unit that starts with a line feed for itself."""
    return text.replace("\n", " \n").split(" ")


class UnitCache:
    """Joins the ids of units, as little-endian 32-bit bytes. encode(list of distinct units) gives those of new ones.

    When the young generation is full it becomes the old one; units still in use move back into the young one, so that
    frequent units stay and rare ones go.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], size: int = CACHE_UNITS) -> None:
        self.encode, self.size, self.young, self.old = encode, size, {}, {}

    def join(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each text, given as units. New units of all these texts are encoded together."""
        out: list[bytes] = []
        start = 0
        while start < len(texts):
            stop, n = start + 1, len(texts[start])
            while stop < len(texts) and n + len(texts[stop]) <= JOINED:
                n, stop = n + len(texts[stop]), stop + 1
            found = list(chain.from_iterable(texts[start:stop]))
            ids = list(map(self.young.get, found))
            if None in ids:
                at = []
                with suppress(ValueError):  # the end of the list
                    i = -1
                    while True:
                        at.append(i := ids.index(None, i + 1))
                fresh = self.resolved({found[i] for i in at})
                for i in at:
                    ids[i] = fresh[found[i]]
            a = 0
            for text in texts[start:stop]:
                out.append(b"".join(ids[a : a + len(text)]))
                a += len(text)
            start = stop
        return out

    def get(self, unit: str) -> bytes | None:
        return self.young.get(unit) or self.old.get(unit)

    def resolved(self, missing: set[str]) -> dict[str, bytes]:
        ids = {u: x for u, x in zip(missing, map(self.old.get, missing)) if x is not None}
        new = list(missing.difference(ids))
        fresh = dict(zip(new, self.encode(new), strict=True))
        if len(self.young) + len(ids) + len(fresh) > self.size:
            self.old, self.young = self.young, {}
        self.young.update(ids)
        ids.update(fresh)
        if max(map(len, new), default=0) > CACHE_CHARS:
            fresh = {u: x for u, x in fresh.items() if len(u) <= CACHE_CHARS}
        self.young.update(fresh)
        return ids
