"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source lies on a line of its documents in hashed order, cut into blocks of about equal words; a document belongs to
the block it starts in. A source whose target is t times its words takes all its blocks floor(t) times (whole rounds)
and draws the rest of its quota from one more round. How many blocks of each source every output shard gets is drawn
from the root of a binary tree over the shards: a node hands half of its shards a multivariate-hypergeometric draw of its
exact block counts and the rest to the other half, down to single shards. In every round a source's blocks are permuted.
Whole rounds are dealt out in runs of the exact counts. In the last round the permuted blocks are cut into a stretch for
each shard, in proportion to what the tree gave it there, and the shard draws the first ones of its stretch; what the
tree says thus decides which documents are taken and where they go. Inside a shard, blocks and then documents take a
hashed order.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loam.llm.shared import saved

#: The weights that sources take in turn, and the most often that a source may be repeated.
WEIGHTS, MOST_TIMES = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Hash ranges a source's line is summed over, blocks in all (about), and the least words in a block.
RANGES, MOST_BLOCKS, LEAST_BLOCK = 4096, 1_000_000, 2048
#: Sources whose quotas the driver may split; each costs one long per output shard.
MOST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> list[float]:
    """The words to take of each source, given (source, words) in code point order, null last.

    The sources take the weights in turn and share all words by them. Where that is over ``most`` times a source's
    words it stops there and the others share the excess by weight, until none is above.
    """
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(n for _, n in sizes))
    while free:
        level = left / sum(weight[k] for k in free)
        over = [k for k in free if weight[k] * level > most * sizes[k][1]]
        for k in over or free:
            target[k] = float(most * sizes[k][1]) if over else weight[k] * level
            left -= target[k]
        free = free - set(over) if over else set()
    return target


def splitting_tree(blocks: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """Exact block counts, sources by shards: every row adds up to the source's blocks, shards differ by one at most."""
    quotas = np.zeros((len(blocks), n_shards), np.int64)

    def split(first: int, last: int, have: np.ndarray) -> None:
        if last - first == 1:
            quotas[:, first] = have
            return
        middle = (first + last) // 2
        draw = np.random.default_rng([seed, first, last])
        left = int(have.sum()) * (middle - first) // (last - first)
        taken = draw.multivariate_hypergeometric(have, left, method="marginals")
        split(first, middle, taken)
        split(middle, last, have - taken)

    split(0, n_shards, blocks)
    return quotas


def _dealt(spark: SparkSession, sizes: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """Per source: target, words of the last round, blocks, whole rounds, and what each shard gets of them.

    ``sizes`` has a row per source: its words and its blocks. ``ends`` are the ends of the shards' runs of the whole
    rounds' blocks, ``stretch`` those of their stretches of the last round and ``drawn`` the blocks they draw there.
    """
    rows = [(r.source, r.source_size, r.n_blocks) for r in sizes.limit(MOST_SOURCES + 1).collect()]
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group small ones first")
    rows.sort(key=lambda r: (r[0] is None, r[0]))
    targets = source_targets([r[:2] for r in rows])
    plans = []
    for (_, size, n), target in zip(rows, targets, strict=True):
        whole, rest = divmod(round(target), size) if size else (0, 0)
        plans.append((whole, rest, min(n, max(1, round(rest * n / size))) if rest else 0))
    quotas = splitting_tree(np.array([whole * r[2] + part for r, (whole, _, part) in zip(rows, plans, strict=True)], np.int64), n_shards, seed)
    out = []
    for (source, size, n), target, (whole, rest, part), quota in zip(rows, targets, plans, quotas, strict=True):
        ends = np.cumsum(quota)
        drawn_ends = np.maximum(0, ends - whole * n)
        stretch = drawn_ends * n // max(1, part)
        out.append((source, size, target, rest, n, whole, ends.tolist(), stretch.tolist(), np.diff(drawn_ends, prepend=0).tolist()))
    return spark.createDataFrame(out, "source string, source_size long, target double, rest long, n_blocks long, whole int, ends array<long>, stretch array<long>, drawn array<long>")


def _draws(blocks: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """(source, block, draws) for every block: an array of (copy, shard, place, before) over its rounds, at most MOST_TIMES.

    ``before`` is null in a whole round. In the last round it is the words of the blocks drawn before this one: the
    drawn blocks come first, in the order of their places, and then the others, which are reached only as far as the drawn
    ones hold fewer words than the source still needs.
    """
    # Bounded: a row per source, at most MOST_SOURCES of them.
    rounds = blocks.join(F.broadcast(targets.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    last = F.col("whole") + F.when(F.col("rest") > 0, 0).otherwise(-1)
    rounds = rounds.withColumn("copy", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
    key = F.xxhash64(F.lit(seed), "source", "block", "copy")
    permuted = Window.partitionBy("source", "copy").orderBy("key", "block")  # at most about MOST_BLOCKS rows
    rounds = rounds.withColumn("key", key).withColumn("at", F.row_number().over(permuted) - 1)
    whole = F.col("copy") < F.col("whole")
    deal = F.col("copy") * F.col("n_blocks") + F.col("at")
    shard = F.when(whole, F.size(F.filter("ends", lambda end: end <= deal))).otherwise(F.size(F.filter("stretch", lambda end: end <= F.col("at"))))
    rounds = rounds.withColumn("shard", F.least(shard, F.size("ends") - 1))
    first = F.when(F.col("shard") > 0, F.element_at("stretch", F.col("shard"))).otherwise(0)
    spare = (F.col("at") - first >= F.element_at("drawn", F.col("shard") + 1)).cast("int")
    line = Window.partitionBy("source", "copy").orderBy("spare", "at")
    before = F.sum("words").over(line) - F.col("words")
    drawn = rounds.withColumn("spare", spare).withColumn("before", before)
    draw = F.struct("copy", "shard", F.col("key").alias("place"), F.when(~whole, F.col("before")).alias("before"))
    return drawn.groupBy("source", "block").agg(F.collect_list(draw).alias("draws"))


def mix(docs: DataFrame, n_shards: int = 64, seed: int = 17) -> DataFrame:
    """Every document of ``docs`` (doc_id, text, source), once for each time the mix takes it.

    Gives doc_id, source, size, source_size, target, tie, range and row (which tell a document from all
    others), copy (0 to 2), taken (words: all, or the first of the document that a source's words end in, or 0 in one row
    for a document that is not taken), shard and place (order in the shard: the upper half is that of the block, the lower
    that of the document; null if not taken). A source's taken words add up to its target, rounded: the blocks drawn are
    the tree's, the last ones are cut where they hold more and further ones follow where they hold less. A very long
    document is a block of its own. Null texts and texts without words have size 0 and are not taken. Null sources are one
    source. Repeated rows are documents of their own; among equal rows it does not matter which is which. Other
    columns are ignored, whatever their names. Everything follows from hashes and ``seed``, so reruns agree.
    """
    spark = docs.sparkSession
    tie = F.xxhash64(F.lit(seed), "doc_id", "text", "source")
    sized = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), tie.alias("tie")), "sizes")
    bucket = F.shiftrightunsigned("tie", 52).cast("int")  # RANGES of them
    parts = saved(sized.groupBy("source", bucket.alias("range")).agg(F.sum("size").alias("words")), "ranges")
    total = parts.agg(F.sum("words")).first()[0] or 0
    width = max(LEAST_BLOCK, -(-total // MOST_BLOCKS))
    ranges = parts.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("range")) - F.col("words"))
    placed = _joined(sized.withColumn("range", bucket), ranges)
    in_range = Window.partitionBy("source", "range").orderBy("tie", "doc_id", "size")
    line = placed.withColumn("row", F.row_number().over(in_range))
    line = line.withColumn("start", F.col("before") + F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).drop("before")
    line = saved(line.withColumn("block", F.floor(F.col("start") / F.lit(width))), "source-lines")
    blocks = saved(line.where("size > 0").groupBy("source", "block").agg(F.sum("size").alias("words"), F.min("start").alias("first")), "blocks")
    sizes = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    n_blocks = blocks.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n_blocks"))
    sizes = sizes.join(n_blocks, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))
    targets = _dealt(spark, sizes, n_shards, seed)
    draws = _draws(blocks.select("source", "block", "words"), targets, seed)
    draws = draws.join(blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), "first"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    draws = draws.select(F.col("source").alias("of"), F.col("block").alias("in"), "first", "draws")
    facts = targets.select(F.col("source").alias("named"), "source_size", "target", "rest")
    placed = line.join(draws, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in")) & (F.col("size") > 0), "left")
    placed = placed.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("named")))  # bounded as above
    offset = F.col("start") - F.col("first")
    lower = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "tie", "row"), 32)

    def copy_of(d: Column) -> Column:
        taken = F.when(d.before.isNull(), F.col("size")).otherwise(F.greatest(F.lit(0), F.least("size", F.col("rest") - d.before - offset)))
        place = F.shiftleft(F.shiftrightunsigned(d.place, 32), 32).bitwiseOR(lower)
        return F.struct(d.copy.alias("copy"), taken.cast("long").alias("taken"), d.shard.alias("shard"), place.alias("place"))

    taken = F.filter(F.transform(F.coalesce("draws", F.array()), copy_of), lambda d: d.taken > 0)
    rows = placed.select("doc_id", "source", "size", "source_size", "target", "tie", "range", "row", F.explode_outer(taken).alias("d"))
    return rows.select(*rows.columns[:-1], F.coalesce("d.copy", F.lit(0)).alias("copy"), F.coalesce("d.taken", F.lit(0)).cast("long").alias("taken"), "d.shard", "d.place")


def _joined(sized: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each document with the words before its range; the small side has a row per source and range that occurs."""
    right = ranges.select(F.col("source").alias("of"), F.col("range").alias("in"), "before")
    return sized.join(right, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in"))).drop("of", "in")


def mixed_documents(docs: DataFrame, n_shards: int = 64, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with their own columns, once for each time they are taken, in the mix's order.

    The rows come range-partitioned by shard and place and sorted by them, so files written from them hold the shards
    one after the other. A document that is taken in part keeps the words that are taken, from its start, as they stand;
    n_chars follows the text. Rows of one doc_id with different texts or sources keep apart; equal rows are taken as
    often as the mix takes them together. Columns may have any names. An empty table stays empty.
    """
    mixed = saved(mix(docs, n_shards, seed).select("doc_id", "tie", "row", "size", "taken", "shard", "place"), "mixed")
    taken = mixed.where("taken > 0").select("tie", F.col("doc_id").alias("id"), "taken", "size", "shard", "place")
    equal = saved(mixed.groupBy("tie", F.col("doc_id").alias("id")).agg(F.max("row").alias("last"), F.min("row").alias("row")).where("last > row").select("tie", "id"), "equal-rows")
    # The rows travel as one struct, so that no name of theirs meets a name of the mix.
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.xxhash64(F.lit(seed), "doc_id", "text", "source").alias("tie"), F.col("doc_id").alias("id"))

    def same(a: DataFrame, b: DataFrame) -> Column:
        return (a["tie"] == b["tie"]) & a["id"].eqNullSafe(b["id"])

    def copies(rows: DataFrame, some: DataFrame) -> DataFrame:
        # What is taken grows with the corpus, so it is never broadcast: texts move once, at any size.
        return rows.join(some.hint("merge"), same(rows, some)).select("doc", "taken", "size", "shard", "place")

    if equal.isEmpty():
        every = copies(marked, taken)
    else:
        first = marked.join(equal, same(marked, equal), "left_semi").dropDuplicates(["tie", "id"])
        rest = copies(marked, taken.join(equal, same(taken, equal), "left_anti"))
        every = rest.unionByName(copies(first, taken.join(equal, same(taken, equal), "left_semi")))
    text = F.when(F.col("taken") == F.col("size"), F.col("doc.text")).otherwise(_first_words(F.col("doc.text"), F.col("taken")))
    ordered = every.withColumn("text", text).repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return ordered.select(*[own[c].alias(c) if c in own else F.col("doc").getField(c).alias(c) for c in docs.columns])


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def taken_words(mixed: DataFrame) -> DataFrame:
    """A row per document of mix(): doc_id, size, source_size, target, the words taken of it, repeats counted, and the
    shards and places of its copies (null where it is not taken)."""
    document = ["doc_id", "tie", "range", "row", "size", "source_size", "target"]
    copies = F.sort_array(F.collect_list(F.when(F.col("taken") > 0, F.struct("copy", "shard", "place"))))  # at most MOST_TIMES
    found = mixed.groupBy(*document).agg(F.sum("taken").alias("taken"), copies.alias("copies"))
    return found.select("doc_id", "size", "source_size", "target", "taken", F.col("copies.shard").alias("shards"), F.col("copies.place").alias("places"))
