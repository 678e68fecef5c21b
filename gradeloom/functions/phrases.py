"""Many fixed phrases in one pass over a text, by an Aho-Corasick automaton that each Python worker builds once a list."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


@cache
def automaton(phrases: tuple[str, ...]):
    """The automaton of distinct phrases; it gives each phrase's place in the tuple and its length. None without phrases."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        found.add_word(p, (i, len(p)))
    if phrases:
        found.make_automaton()
    return found if phrases else None


def occurrences(text: str, phrases: tuple[str, ...]) -> np.ndarray:
    """How often each phrase occurs, from left to right and without overlaps of its own; other phrases may overlap it."""
    counts, behind = np.zeros(len(phrases), np.int64), {}
    machine = automaton(phrases)
    if machine is None or not text:
        return counts
    for last, (i, size) in machine.iter(text):
        if last - size >= behind.get(i, -1):
            counts[i] += 1
            behind[i] = last
    return counts


def _distinct(phrases: Sequence[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(p for p in phrases if p))


def phrase_counts(text: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """struct with a double for each group: how often its phrases occur in a text. All groups share one pass; null counts as empty.

    A phrase that a group names twice counts twice, and one that several groups have counts in each.
    """
    phrases = _distinct([p for ps in groups.values() for p in ps])
    at = {p: i for i, p in enumerate(phrases)}
    shares = np.zeros((len(phrases), len(groups)))
    for g, ps in enumerate(groups.values()):
        for p in filter(None, ps):
            shares[at[p], g] += 1
    names = list(groups)

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            counts = np.array([occurrences(t or "", phrases) for t in texts]).reshape(len(texts), len(phrases))
            yield pd.DataFrame(counts @ shares, columns=names)

    return count(text)


def phrases_found(text: Column, phrases: Sequence[str]) -> Column:
    """array<int>: the places (from 0, ascending) of the phrases that a text has; null counts as empty."""
    distinct = _distinct(phrases)
    places = [[i for i, p in enumerate(phrases) if p == d] for d in distinct]

    @F.pandas_udf(ArrayType(IntegerType()))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sorted(i for j in np.flatnonzero(occurrences(t or "", distinct)) for i in places[j]) for t in texts])

    return found(text)
