"""Many literal patterns in one pass over each text, by an Aho-Corasick automaton.

A text is read once however many patterns there are. What goes to the tasks is
the patterns, up to ``MOST_CHARS`` characters at a time; a worker builds the
automaton when it first meets them and keeps it. Larger registries are parted
by hash into as many sets as they need, each with a pass of its own, so nothing
that grows without bound is sent or collected at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Characters of the patterns of one automaton, and automata that a worker keeps.
MOST_CHARS, KEPT = 1 << 20, 4

_built: dict[str, object] = {}


def _automaton(patterns: tuple[str, ...], name: str):
    if name not in _built:
        import ahocorasick

        if len(_built) >= KEPT:
            _built.clear()
        machine = ahocorasick.Automaton()
        for pattern in patterns:
            machine.add_word(pattern, pattern)
        machine.make_automaton()
        _built[name] = machine
    return _built[name]


def _found_by(patterns: tuple[str, ...], text: Column) -> Column:
    """The distinct ``patterns`` that are parts of the text."""
    name = hashlib.sha256("\x00".join(patterns).encode()).hexdigest()

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = _automaton(patterns, name)
        for texts in batches:
            yield pd.Series([sorted({p for _, p in machine.iter(t)}) if t else [] for t in texts])

    return F.pandas_udf(found, ArrayType(StringType()))(text)


def pattern_hits(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str = "pattern", most_chars: int = MOST_CHARS) -> DataFrame:
    """(key, pattern) for each row and each distinct pattern that is a part of its text, case as given.

    Null and empty patterns are in no text; a null text holds nothing.
    """
    known = patterns.select(F.col(pattern).alias("pattern")).where("pattern is not null and pattern <> ''").distinct()
    chars = known.agg(F.sum(F.char_length("pattern"))).first()[0] or 0
    sets = -(-chars // most_chars)
    hits = texts.select(key, F.lit(None).cast("string").alias("pattern")).where("false")
    for number in range(sets):
        mine = known.where(F.pmod(F.xxhash64("pattern"), F.lit(sets)) == number)
        some = tuple(sorted(r["pattern"] for r in mine.collect()))
        if some:
            hits = hits.unionByName(texts.select(key, F.explode(_found_by(some, F.col(text))).alias("pattern")))
    return hits
