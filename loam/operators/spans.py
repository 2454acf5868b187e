"""Where an excerpt stands in its text, in expressions alone, and how close a command comes to it, in Arrow batches."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

#: The shortest prefix that counts as found; the shortest word to align on, and the most places tried.
LEAST_PREFIX, LEAST_WORD, MOST_PLACES = 40, 6, 40
#: A run of the signs that Unicode counts as white space.
SPACES = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def closeness(command: str | None, source: str | None) -> float:
    """The best ratio of matching blocks between the command and a window of the source aligned on a long word."""
    best, tried = 0.0, 0
    match = difflib.SequenceMatcher(None, command or "", autojunk=False)
    for word in sorted({w for w in (command or "").split() if len(w) >= LEAST_WORD}, key=lambda w: (-len(w), w)):
        offset, at = command.index(word), (source or "").find(word)
        while at >= 0 and tried < MOST_PLACES:
            tried += 1
            start = max(0, at - offset)
            match.set_seq2(source[start : start + len(command)])
            if match.real_quick_ratio() > best and match.quick_ratio() > best:  # bounds by lengths and by shared letters
                best = max(best, match.ratio())
            at = source.find(word, at + 1)
    return best


def excerpt_span(excerpt: Column, text: Column) -> Column:
    """Struct of first and last (left out) of an excerpt in its text, from 0; -1 for both where it is not there.

    As it stands it comes first; else runs of white space are equal to one another, and white space around the excerpt does not count. What is
    not in the text so either gives the place of its longest prefix of whole words that is, if that has LEAST_PREFIX letters; of equal places the first counts. A null or
    empty excerpt or text holds nothing. All of it is expressions: prefixes are halved, as a prefix of a prefix that is there is there too.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), F.lit(SPACES), F.lit(" ")))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")

    def longest(pair: Column) -> Column:
        ends = F.aggregate(words(pair["wanted"]), F.array().cast("array<int>"), lambda done, w: F.concat(done, F.array((F.coalesce(F.try_element_at(done, F.lit(-1)) + 1, F.lit(0)) + F.length(w)).cast("int"))))
        start = F.struct(F.lit(0).alias("low"), F.size(ends).cast("int").alias("high"), ends.alias("ends"))  # the first ``low`` words are there, the first ``high`` are not

        def halved(at: Column) -> Column:
            middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
            there = (middle > at["low"]) & F.contains(pair["normal"], F.substring(pair["wanted"], F.lit(1), F.coalesce(F.get(at["ends"], middle - 1), F.lit(0))))
            return F.struct(F.when(there, middle).otherwise(at["low"]).alias("low"), F.when(there, at["high"]).otherwise(F.greatest(middle, at["low"] + 1)).cast("int").alias("high"), at["ends"].alias("ends"))

        steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(ends) + 1.0)).cast("int") + 1)
        found = F.aggregate(steps, start, lambda at, _: halved(at))
        cut = F.coalesce(F.get(found["ends"], found["low"] - 1), F.lit(0))
        return F.when(cut >= LEAST_PREFIX, F.substring(pair["wanted"], F.lit(1), cut))

    def placed(known: Column) -> Column:
        quoted = F.transform(words(known), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
        told = F.regexp_substr(text, F.array_join(quoted, SPACES))
        at = F.call_function("locate", told, text) - 1  # an earlier place of the same signs would have matched
        return F.struct(at.cast("int").alias("first"), (at + F.length(told)).cast("int").alias("last"))

    none = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    as_is = F.when(excerpt != "", F.call_function("locate", excerpt, text))
    pair = F.struct(flat(excerpt).alias("wanted"), F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(SPACES), F.lit(" ")).alias("normal"))
    held = lambda p: F.when(p["wanted"] == "", None).when(F.contains(p["normal"], p["wanted"]), p["wanted"]).otherwise(longest(p))
    other = once(pair, lambda p: once(held(p), placed))
    return F.when(as_is > 0, F.struct((as_is - 1).cast("int").alias("first"), (as_is - 1 + F.length(excerpt)).cast("int").alias("last"))).otherwise(F.when(other["first"] >= 0, other).otherwise(none))


def near_ratio(command: Column, source: Column) -> Column:
    """closeness(); only commands that share a long word with their source, but do not stand in it whole, go to Python."""

    def ratios(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([closeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    long = F.filter(F.split(command, r"\s+"), lambda w: F.length(w) >= LEAST_WORD)
    shares = F.coalesce(F.exists(long, lambda w: F.contains(source, w)), F.lit(False))
    whole = shares & F.contains(source, command)
    asked = shares & ~whole
    return F.when(whole, F.lit(1.0)).otherwise(F.pandas_udf(ratios, "double")(F.when(asked, command), F.when(asked, source)))
