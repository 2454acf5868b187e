"""Many names in one reading of a text: an Aho-Corasick automaton that tasks build from a broadcast of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

#: Bytes of names that one automaton holds, about; its nodes take some forty times as much in a task.
BLOCK_BYTES = 4 << 20
FOUND = "array<struct<first: int, last: int, place: long, name: string>>"
#: The signs that may not stand beside a name that must stand alone.
INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_BUILT: dict[int, tuple] = {}


def automaton(sent: Broadcast):
    """The automaton of broadcast (name, place) pairs, built once per worker; the newest two stay."""
    number = id(sent.value)
    if number not in _BUILT:
        import ahocorasick

        built = ahocorasick.Automaton()
        for name, place in sent.value:
            built.add_word(name, (name, place))
        built.make_automaton()
        while len(_BUILT) > 1:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[number] = (built, sent.value)
    return _BUILT[number][0]


def stands_alone(text: str, first: int, last: int) -> bool:
    """Whether no letter a-z and no digit stands just before ``first`` or at ``last``."""
    return (first == 0 or text[first - 1] not in INNER) and (last == len(text) or text[last] not in INNER)


def leftmost(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Matches that do not overlap, from left to right; of those that begin at one place the first by place in the list."""
    kept, end = [], 0
    for match in sorted(found, key=lambda m: (m[0], m[2])):
        if match[0] >= end:
            kept.append(match)
            end = match[1]
    return kept


def first_of_each(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """The first match of every name."""
    kept: dict[str, tuple[int, int, int, str]] = {}
    for match in sorted(found):
        kept.setdefault(match[3], match)
    return list(kept.values())


def _scanner(sent: Broadcast, alone: bool, settle: Callable | None) -> Callable:
    def scan(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        built = automaton(sent)
        for texts, before in batches:
            rows = []
            for text, known in zip(texts, before, strict=True):
                found = [(m["first"], m["last"], m["place"], m["name"]) for m in known]
                if text and len(built):
                    matches = ((end + 1 - len(name), end + 1, place, name) for end, (name, place) in built.iter(text))
                    found += [m for m in matches if not alone or stands_alone(text, m[0], m[1])]
                if settle is not None:
                    found = settle(found)
                rows.append([dict(zip(("first", "last", "place", "name"), m, strict=True)) for m in sorted(found)])
            yield pd.Series(rows, dtype=object)

    return scan


def found_names(texts: DataFrame, names: DataFrame, text: str = "text", column: str = "found", alone: bool = False, settle: Callable | None = None) -> DataFrame:
    """``texts`` with an array ``column`` of the matches (first, last: signs, from 0, last excluded; place; name) of ``names`` (name, place).

    Names and texts are compared as they are. ``alone``: no letter a-z and no digit may stand beside a match. ``settle`` takes all matches of a
    text and gives those that stay; without it all do, in order. Names are different ones; null and empty ones are none; null texts hold none. A text is
    read once for every BLOCK_BYTES of names, about; each reading adds to what the ones before have found, so any number of names
    gives the same matches. Nothing is shuffled.
    """
    spark = texts.sparkSession
    named = names.select("name", F.col("place").cast("long").alias("place")).where("name is not null and name <> ''")
    size = named.agg(F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK_BYTES)
    out = texts.withColumn(column, F.array().cast(FOUND))
    for number in range(blocks):
        block = F.pmod(F.xxhash64("name"), F.lit(blocks).cast("long")) == number
        sent = spark.sparkContext.broadcast([(r["name"], r["place"]) for r in named.where(block).collect()])
        last = number == blocks - 1
        out = out.withColumn(column, F.pandas_udf(_scanner(sent, alone, settle if last or settle is first_of_each else None), FOUND)(F.col(text), F.col(column)))
    return out
