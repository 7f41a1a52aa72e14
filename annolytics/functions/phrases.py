"""All phrases of a rule set, found in one pass over each text and kept as bits."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches
from .columns import col

BITS = 62  # phrases per number of a bit set

#: (name of a text, phrases) → whether any of them occurs in it; null for a null text
Hits = Callable[[str, Sequence[str]], Column]


class Phrases:
    """Distinct phrases with their places in a bit set."""

    def __init__(self, phrases: Iterable[str]):
        self.place = {p: i for i, p in enumerate(dict.fromkeys(phrases))}
        self.numbers = -(-len(self.place) // BITS)

    def find(self, text: str | Column) -> Column:
        """Bit set (array of long) of the phrases that occur in ``text``, overlapping ones included.

        One automaton reads each text once, however many phrases there are. The column is marked as not
        deterministic only so that the optimizer doesn't copy it into every condition on it. A Python worker
        holds a few MB of texts at a time.
        """
        bound_batches(SparkSession.active())
        place, numbers = self.place, self.numbers

        def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for phrase, i in place.items():
                automaton.add_word(phrase, 1 << i)
            automaton.make_automaton()
            low = (1 << BITS) - 1

            def one(value: str | None) -> list[int] | None:
                if value is None:
                    return None
                found = 0
                for _, bit in automaton.iter(value):
                    found |= bit
                return [found >> (BITS * i) & low for i in range(numbers)]

            for texts in batches:
                yield texts.map(one)

        sets.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(sets, "array<long>").asNondeterministic()(col(text))

    def hits(self, sets: dict[str, str | Column]) -> Hits:
        """Bit tests on columns made by ``find``, by the names of their texts."""

        def test(name: str, phrases: Sequence[str]) -> Column:
            wanted = sum(1 << self.place[p] for p in set(phrases))
            parts = [(i, wanted >> (BITS * i) & ((1 << BITS) - 1)) for i in range(self.numbers)]
            hit = None
            for i, bits in parts:
                if bits:
                    one = F.get(col(sets[name]), F.lit(i)).bitwiseAND(F.lit(bits)) != 0
                    hit = one if hit is None else hit | one
            return F.lit(False) if hit is None else hit

        return test
