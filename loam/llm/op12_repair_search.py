"""Conversation structure repair by iterative-deepening A*.

A conversation is a string of codes: the initial of each row's role, or that the row must go. Edits turn it into a string of
``(s?(ua)+)?``. A depth-first search tries the edits of a row in ASCII order, cuts every branch whose cost so far and least cost
to come exceed the bound, keeps the states that failed with what they had left to spend, and starts again with the
least cost that was cut; so the first path that is accepted is the cheapest, and of those the least in ASCII.

Long conversations are searched in blocks of rows, from each state that a block may begin in to each that it may end in;
inserts belong to the block of the next row. No path of a block is the beginning of another one with the same ends and
cost, so the blocks' least paths make the least path of the whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loam.llm.shared import saved

#: Rows in a block, which bounds the depth of a search.
BLOCK = 128
#: The kinds of white space, and what the edits cost, by initial.
WHITE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: State of the pattern -> initial of a role -> next state: nothing yet, after s, after u, after a. An added or
#: changed role is the user's but after u.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ADDED = (2, 2, 3, 2)
LETTER = " sua"
NEVER = 1 << 60


class Search:
    """The cheapest edits of one block of codes; a code is s, u, a or x for a role, in capitals if truncated, or - for a row that must go."""

    def __init__(self, codes: str, last: bool):
        self.codes, self.last, self.n = codes, last, len(codes)
        self.letters = codes.lower()
        forced, k = [0] * (self.n + 1), [0] * (self.n + 1)
        stay = [c for c in self.letters if c != "-"]
        k[self.n] = len(stay)
        for i in range(self.n - 1, -1, -1):
            forced[i] = forced[i + 1] + (DELETE if codes[i] == "-" else TRUNCATED if codes[i].isupper() else 0)
            k[i] = k[i + 1] - (codes[i] != "-")
        self.forced, self.next, self.stay = forced, k, stay

    def _pairs(self, end: int | None) -> tuple[list[int], list[int]]:
        """For each staying row: misfits in a row that begin with it and what follows it, and a bound of all misfits from there on."""
        run, total = [0] * (len(self.stay) + 1), [0] * (len(self.stay) + 1)
        for j in range(len(self.stay) - 1, -1, -1):
            here = self.stay[j]
            after = self.stay[j + 1] if j + 1 < len(self.stay) else None
            fits = here + after in ("su", "ua", "au") if after else here == ("a" if end is None else LETTER[end])
            run[j] = 0 if fits else 1 + run[j + 1]
            total[j] = total[j + 1] if fits else 2 * ((run[j] + 1) // 2) + total[j + run[j]]
        return run, total

    def cheapest(self, begin: int, end: int | None) -> tuple[int, str] | None:
        """(cost, path) from state ``begin`` to ``end``; None is any state that the pattern accepts."""
        run, total = self._pairs(end)

        def to_come(i: int, q: int) -> int:
            """No more than the cost from here on. An edit touches the pairs of one row or between two rows, so it mends at most two
            misfits, next to each other, and costs two at least beyond what its row costs anyway."""
            if end in (0, 1):  # all rows go, but for one s where the pattern has not begun
                if q > end or (end == 1 and q == 0 and "s" not in self.letters[i:]):
                    return NEVER
                return DELETE * (self.n - i - (end > q))
            j = self.next[i]
            if j == len(self.stay):
                fits = q in (0, 3) if end is None else q == end
                return self.forced[i] + (0 if fits else 2)
            if self.stay[j] in STEPS[q]:
                return self.forced[i] + total[j]
            return self.forced[i] + 2 * ((run[j] + 2) // 2) + total[j + run[j]]

        def moves(i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
            if i < self.n:
                yield "D", i + 1, q, DELETE
            if i < self.n or self.last:
                yield "I", i, ADDED[q], INSERT
            if i < self.n and self.codes[i] != "-":
                extra = TRUNCATED if self.codes[i].isupper() else 0
                if self.letters[i] in STEPS[q]:
                    yield "K", i + 1, STEPS[q][self.letters[i]], extra
                yield "R", i + 1, ADDED[q], REROLE + extra

        def first(i: int, q: int, left: int) -> str | None:
            nonlocal above
            if i == self.n and (q in (0, 3) if end is None else q == end):
                return ""
            if failed.get((i, q), -1) >= left:
                return None
            for edit, j, r, cost in moves(i, q):
                least = cost + to_come(j, r)
                if least > left:
                    above = min(above, bound + least - left)
                elif (rest := first(j, r, left - cost)) is not None:
                    return edit + rest
            failed[i, q] = left
            return None

        bound = to_come(0, begin)
        while bound < NEVER:
            failed: dict[tuple[int, int], int] = {}
            above = NEVER
            path = first(0, begin, bound)
            if path is not None:
                return bound, path
            bound = above
        return None


def repaired_paths(codes: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(begin, end, cost, path) of every way through a block; the end is -1 in the last one."""
    search, found = Search(codes, last), []
    for begin in (0,) if first else range(4):
        for end in (None,) if last else range(4):
            if (best := search.cheapest(begin, end)) is not None:
                found.append((begin, -1 if end is None else end, *best))
    return found


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that crc32(``conv_id:turn``) % 20 asks for; nulls of any column but turn and
    conv_id become one space, which stands for those two where they are hashed."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(of("text"), "[.!?]", "")).otherwise(of("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(of("role"))
    copies = F.explode(F.array_repeat(F.lit(True), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_")).drop("_")


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def _marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, place, code, last, blank, duplicate, truncated, illegal) of every row; texts are not shuffled."""
    ends = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    slim = rows.select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), initial.alias("initial"), (ends == "").alias("blank"), (~F.substring(ends, -1, 1).isin(".", "!", "?")).alias("open")
    )
    by_place = Window.partitionBy("conv_id").orderBy(*_order())
    placed = slim.select(
        "*", F.row_number().over(by_place).alias("place"), F.lead(F.lit(1)).over(by_place).isNull().alias("last"), F.concat(F.lag("initial").over(by_place), "initial").alias("pair")
    )
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("place")) > 1
    faulty = placed.withColumn("again", again)
    duplicate = ~F.col("blank") & F.col("again")
    truncated = ~F.col("blank") & ~F.col("again") & F.col("open")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    code = F.when(F.col("blank") | F.col("again"), "-").when(truncated, F.upper(letter)).otherwise(letter)
    illegal = F.coalesce(~F.col("pair").isin("su", "ua", "au"), F.lit(False))
    return faulty.select("conv_id", "turn", "place", code.alias("code"), "last", "blank", duplicate.alias("duplicate"), truncated.alias("truncated"), illegal.alias("illegal"))


def _paths(marked: DataFrame) -> DataFrame:
    """(conv_id, block, cost, path): the edits of every block in the cheapest repair, and what the whole repair costs."""

    def of_blocks(codes: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        known: dict[tuple, list] = {}
        out = []
        for key in zip(codes, first, last, strict=True):
            if key not in known:
                known[key] = repaired_paths(*key)
            out.append(known[key])
        return pd.Series(out, dtype=object)

    ways = F.pandas_udf(of_blocks, "array<struct<begin: int, end: int, cost: long, path: string>>")
    block = F.floor((F.col("place") - 1) / F.lit(BLOCK)).cast("long")
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]), "")
    blocks = marked.groupBy("conv_id", block.alias("block")).agg(codes.alias("codes"), F.max("last").alias("last")).repartition("conv_id", "block")
    found = saved(blocks.select(F.col("conv_id").cast("string").alias("conv_id"), "block", "last", ways("codes", F.col("block") == 0, "last").alias("ways")), "block-paths")
    single = (F.col("block") == 0) & F.col("last")
    alone = found.where(single).select("conv_id", "block", F.col("ways")[0]["cost"].alias("cost"), F.col("ways")[0]["path"].alias("path"))

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks come last first; of each only the best way on from each state stays."""
        best: dict[int, int] = {}
        behind: list[tuple[int, dict]] = []
        for batch in batches:
            for conv, block, last, ways in zip(batch["conv_id"], batch["block"], batch["last"], batch["ways"], strict=True):
                if last:
                    best, behind = {-1: 0}, []
                on: dict[int, tuple[int, str, int]] = {}
                for way in ways:
                    if way["end"] in best:
                        here = (way["cost"] + best[way["end"]], way["path"], way["end"])
                        on[way["begin"]] = min(on.get(way["begin"], here), here)
                best = {q: cost for q, (cost, _, _) in on.items()}
                behind.append((block, on))
                if block == 0:
                    state, rows = 0, []
                    for at, chosen in reversed(behind):
                        _, path, state_after = chosen[state]
                        rows.append((conv, at, best[0], path))
                        state = state_after
                    yield pd.DataFrame(rows, columns=["conv_id", "block", "cost", "path"], dtype=object)

    long_ones = found.where(~single).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    return alone.unionByName(long_ones.mapInPandas(chained, "conv_id string, block long, cost long, path string"))


def _rebuilt(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """(conv_id, cost, audit, repaired_sha256): each conversation's rows stream past its edits; none is held as a whole."""
    heads = paths.select("conv_id", F.lit(0).alias("kind"), "block", "cost", F.col("path").alias("text"))
    lines = rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.lit(1).alias("kind"), "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    both = heads.unionByName(lines, allowMissingColumns=True).repartition("conv_id")
    ordered = both.sortWithinPartitions("conv_id", "kind", "block", *_order()).select("conv_id", "kind", F.coalesce("cost", F.lit(0).cast("long")).alias("cost"), "role", "text")

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, open_, done = None, False, []
        for batch in batches:
            for name, kind, cost, role, text in zip(batch["conv_id"], batch["kind"], batch["cost"], batch["role"], batch["text"], strict=True):
                if not open_ or name != conv:
                    if open_:
                        done.append(repair.result(conv))
                    conv, open_, repair = name, True, _Repair(cost)
                if kind == 0:
                    repair.paths.append(text)
                else:
                    repair.row(role, text)
            yield pd.DataFrame(done, columns=["conv_id", "cost", "audit", "repaired_sha256"], dtype=object)
            done = []
        if open_:
            yield pd.DataFrame([repair.result(conv)], columns=["conv_id", "cost", "audit", "repaired_sha256"], dtype=object)

    return ordered.mapInPandas(rebuild, "conv_id string, cost long, audit string, repaired_sha256 string")


class _Repair:
    """Edits meet rows in order; repaired lines go into a digest."""

    def __init__(self, cost: int):
        self.cost, self.paths, self.audit, self.at, self.state, self.digest, self.lines = cost, [], None, 0, 0, hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def _inserts(self) -> None:
        if self.audit is None:
            self.audit = "".join(self.paths)
        while self.audit[self.at : self.at + 1] == "I":
            self.state = ADDED[self.state]
            self._line("assistant" if self.state == 3 else "user", "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEPS[self.state][role[0]]
            self._line(role, text)
        elif edit == "R":
            self.state = ADDED[self.state]
            self._line("assistant" if self.state == 3 else "user", text)

    def result(self, conv: str | None) -> tuple[str | None, int, str, str]:
        self._inserts()
        return conv, self.cost, self.audit, self.digest.hexdigest()


def repaired(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of ``rows`` (conv_id, turn, role,
    text: no null roles or texts) and of every further conv_id in ``conversations``, which has no rows: zeros, no edits, the hash
    of an empty text.

    Rows go by turn, nulls first, rows of one turn by role and then by the SHA-256 of the text, so repeated rows stand together
    and all but the first are duplicates. A null conv_id is a conversation like any other. A role with another initial than
    s, u and a, or none, must go or change. Texts are read whole and never held together: they pass by once, in order of their
    conversation. A conversation's search is cut into blocks over all tasks; what one task does for a whole conversation
    is to number its rows, to follow the chain of its blocks and to hash its lines. Other columns are ignored; an empty table gives
    none.
    """
    kind = rows.schema["conv_id"].dataType
    marked = saved(_marked(rows), "marked-rows")
    counted = marked.groupBy("conv_id", "turn").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.count("turn"))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    counts = counted.groupBy(F.col("conv_id").cast("string").alias("conv_id")).agg(F.least(gaps, F.lit(Decimal(2**63 - 1))).cast("long").alias("gaps"), *sums)
    paths = saved(_paths(marked), "paths")
    every = _rebuilt(rows, paths).unionByName(counts, allowMissingColumns=True)
    if conversations is not None:
        every = every.unionByName(conversations.select(F.col("conv_id").cast("string").alias("conv_id")).distinct(), allowMissingColumns=True)
    longs = [F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    whole = every.groupBy("conv_id").agg(*longs, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(nothing)).alias("repaired_sha256"))
    return whole.withColumn("conv_id", F.col("conv_id").cast(kind))


def _oracle_sql() -> str:
    """The same by dynamic programming over rows: the cheapest edits, and of those the least, that end in each state."""
    put = lambda q, cost, edit, line="''": f"{{'c': a[{q}].c + {cost}, 'e': a[{q}].e || '{edit}', 't': a[{q}].t || {line}}}"
    line = lambda role, text: f"chr(10) || {role} || ':' || {text}"
    add = lambda q: put(q, 2, "I", line("'assistant'" if q == 3 else "'user'", "''"))
    none = "{'c': 1000000000::BIGINT, 'e': '', 't': ''}"
    best = lambda *of: f"list_sort([{', '.join(of)}])[1]"
    inserted = f"[a[1], a[2], {best('a[3]', add(1), add(2), add(4))}, {best('a[4]', add(3))}]"
    keep = lambda q, letter: f"CASE WHEN NOT gone AND initial = '{letter}' THEN {put(q, 'open', 'K', line('role', 'text'))} ELSE {none} END"
    rerole = lambda q: f"CASE WHEN NOT gone THEN {put(q, '2 + open', 'R', line(chr(39) + ('assistant' if q == 3 else 'user') + chr(39), 'text'))} ELSE {none} END"
    drop = lambda q: put(q, 3, "D")
    user = [drop(3), *(keep(q, "u") for q in (1, 2, 4)), *(rerole(q) for q in (1, 2, 4))]
    step = f"[{drop(1)}, {best(drop(2), keep(1, 's'))}, {best(*user)}, {best(drop(4), keep(3, 'a'), rerole(3))}]"
    twice = lambda a: f"list_transform(list_transform([{a}], lambda a: {inserted}), lambda a: {inserted})"
    return f"""
WITH RECURSIVE crc_table(k, v, i) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM crc_table WHERE i < 8
), crc_list AS (
  SELECT list(v ORDER BY k) AS t FROM crc_table WHERE i = 8
), source AS (
  SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), crc(r, key, i, v) AS (
  SELECT r, key, 1, 4294967295 FROM source
  UNION ALL SELECT r, key, i + 1, xor(v >> 8, t[(xor(v, ascii(substr(key, i, 1))) & 255) + 1]) FROM crc, crc_list WHERE i <= length(key)
), kinds AS (
  SELECT r, xor(v, 4294967295) % 20 AS kind FROM crc WHERE i = length(key) + 1
), damaged AS (
  SELECT r, conv_id, turn, copy, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM source JOIN kinds USING (r), (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), placed AS (
  SELECT *, substr(role, 1, 1) AS initial, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last_sign,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS place
  FROM damaged
), faulty AS (
  SELECT *, last_sign = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair
  FROM placed
), marked AS (
  SELECT conv_id, turn, place, role, text, initial, pair, blank, NOT blank AND again AS duplicate, NOT blank AND NOT again AND last_sign NOT IN ('.', '!', '?') AS truncated,
         blank OR again AS gone, CASE WHEN NOT blank AND NOT again AND last_sign NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS open
  FROM faulty
), sizes AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
), states(conv_id, place, a) AS (
  SELECT conv_id, 0::BIGINT, [{{'c': 0::BIGINT, 'e': '', 't': ''}}, {none}, {none}, {none}] FROM sizes
  UNION ALL
  SELECT s.conv_id, m.place, list_transform({twice('s.a')}, lambda a: {step})[1]
  FROM states s JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.place = s.place + 1
), ended AS (
  SELECT s.conv_id, list_transform({twice('s.a')}, lambda a: {best('a[1]', 'a[4]')})[1] AS best FROM states s JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM s.conv_id AND z.n = s.place
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0) AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


#: The same by dynamic programming over rows.
ORACLE_SQL = _oracle_sql()
