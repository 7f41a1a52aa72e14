"""Values of recent keys in a Python worker, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Generic, TypeVar

K = TypeVar("K")
V = TypeVar("V")


class Recent(Generic[K, V]):
    """Two generations of at most ``size`` keys. A key that is asked for moves to the young one; when that is
    full, the old one goes, so that only keys without recent use are lost."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict[K, V] = {}
        self.old: dict[K, V] = {}

    def with_all(self, keys: set[K], make: Callable[[list[K]], Mapping[K, V] | Iterable[tuple[K, V]]]) -> dict[K, V]:
        """A dict that has at least ``keys``; ``make`` gives the values of those that neither generation has."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        if missing := keys.difference(young):
            new = missing.difference(old)
            young.update((k, old[k]) for k in missing.difference(new))
            if new:
                young.update(make(list(new)))
        return young

    def drop(self, keys: Iterable[K]) -> None:
        for k in keys:
            self.young.pop(k, None)
