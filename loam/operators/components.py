"""Connected components by randomised contraction of the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loam.sources.shared import dropped, saved

#: Rows of one key beyond which it is looked up in a broadcast instead of joined; of n rows no more than n / HEAVY keys are.
HEAVY = 100_000


def looked_up(rows: DataFrame, key: str, names: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """``rows`` with the columns that ``names`` has for ``key``, null where it has none; ``heavy``: the keys that may have over HEAVY rows.

    Names are shuffled at any size: the many small tables of late rounds would else each be collected and broadcast by the driver.
    """
    names = names.hint("merge")
    if heavy is None:
        return rows.join(names, key, "left")
    known = heavy.join(names, key, "left")  # as few as the heavy keys
    often = rows.join(F.broadcast(known), key)
    rest = rows.join(F.broadcast(heavy), key, "left_anti").join(names, key, "left")
    return often.unionByName(rest)


def heavy_keys(counted: DataFrame, key: str, name: str) -> DataFrame | None:
    """The values of ``key`` that ``counted`` (key, n) gives over HEAVY rows, as ``name``; None if there are none."""
    heavy = counted.where(F.col("n") > HEAVY).select(F.col(key).alias(name))
    return None if heavy.isEmpty() else heavy


def _renamed(edges: DataFrame, to: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """The different edges between the names that ``to`` gives both ends."""
    for end in "ab":
        names = to.select(F.col("node").alias(end), F.col("to").alias(f"new_{end}"))
        edges = looked_up(edges, end, names, None if heavy is None else heavy.select(F.col("node").alias(end)))
    x, y = F.col("new_a"), F.col("new_b")
    return edges.where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def connected_components(edges: DataFrame, contractions: list[int] | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reachable.

    In a round every node takes the name of the first of itself and its neighbours in an order by hash, both ends of every
    edge are renamed, and the different edges that still join two names stay. A name stays only if it comes first
    around some node; under a random order that leaves at most three quarters of the nodes on average, so the rounds
    grow as the logarithm of the nodes, whatever their ids and whatever the shape of the graph. An order serves two rounds, as a
    star's hub takes the first leaf's name in one and all leaves do in the next: a path of 10,000 nodes takes about 15 rounds, of
    a million about 21, a star of any size 2. ``contractions`` takes the edges that each round began with.

    Names are composed backwards from the last round, so a node is joined once a round that it lives in. Keys with over HEAVY rows,
    such as hubs, are looked up in a broadcast of at most one row in HEAVY. Loops, repeated edges, nulls and an empty table are
    allowed; a null end is no edge.
    """
    spark = edges.sparkSession
    kept = edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = saved(kept.distinct(), "edges")
    rounds: list[tuple[DataFrame, DataFrame | None]] = []
    while not edges.isEmpty():
        if contractions is not None:
            contractions.append(edges.count())
        place = lambda c: F.xxhash64(c, F.lit(len(rounds) // 2))  # noqa: B023, E731
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min_by("b", place("b")).alias("first"), F.count("*").alias("n"))
        name = F.when(place("first") < place("a"), F.col("first")).otherwise(F.col("a"))
        to = saved(least.select(F.col("a").alias("node"), name.alias("to"), "n"), "names")
        heavy = heavy_keys(to, "node", "node")
        before, edges = edges, saved(_renamed(edges, to, heavy), "edges")
        rounds.append((to.select("node", "to"), heavy))
        rounds[-1][0].__dict__["_table"] = to
        dropped(before)
    dropped(edges)
    if not rounds:
        return spark.createDataFrame([], "node long, component long")
    known = None
    for to, heavy in reversed(rounds):
        if known is None:
            known = to
            continue
        # a name is taken by a hub's neighbours only, so the hubs are all names that may have many rows
        later = known.select(F.col("node").alias("to"), F.col("to").alias("last"))
        found = looked_up(to, "to", later, None if heavy is None else heavy.select(F.col("node").alias("to")))
        before, known = known, saved(found.select("node", F.coalesce("last", "to").alias("to")), "names")
        dropped(before, to.__dict__["_table"])
    classes = saved(known.groupBy("to").agg(F.min("node").alias("component"), F.count("*").alias("n")), "classes")
    return looked_up(known, "to", classes.select("to", "component"), heavy_keys(classes, "to", "to")).select("node", "component")
