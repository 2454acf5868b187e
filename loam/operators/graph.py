"""Sequence graphs: edges, operators where paths meet or part, bridges, reachability, components, checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from loam.sources.shared import dropped, saved

#: Edges and starts of a group up to which one task walks it.
SMALL = 2_000


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) without loops and without a missing end."""
    return edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    clean = clean_edges(edges)
    return clean.union(clean.select("dst", "src")).distinct()


def joints(edges: DataFrame) -> DataFrame:
    """(node, role, n): converge for nodes with several sources, branch for nodes with several targets."""
    clean = clean_edges(edges)
    into = clean.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).withColumn("role", F.lit("converge"))
    out = clean.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).withColumn("role", F.lit("branch"))
    return into.unionByName(out).where("n >= 2").select("node", "role", "n")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge ends in."""
    return nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref, field, holder) for every end of an edge that is no node."""
    ends = edges.select("id", F.explode(F.create_map(F.lit("src"), F.col("src"), F.lit("dst"), F.col("dst"))).alias("field", "ref"))
    return ends.where("ref is not null").join(nodes.select(F.col("node").alias("ref")), "ref", "left_anti").select("ref", "field", F.col("id").alias("holder"))


def link_orphans(steps: DataFrame) -> DataFrame:
    """(group, src, dst): the step before, in order, for every step that has no predecessor and is no root."""
    before = F.lag("step").over(Window.partitionBy("group").orderBy("step"))
    return steps.withColumn("src", before).where("not has_predecessor and not is_root and src is not null").select("group", "src", F.col("step").alias("dst"))


def splice(edges: DataFrame, present: DataFrame) -> DataFrame:
    """Edges between present nodes, absent ones bridged to their nearest present descendants; no loops.

    Walks only through absent nodes, however many there are in a row, each (start, place) once, so cycles end. Edges are written once, with
    which of their ends are present, and each step joins those alone that begin at an absent node; equal edges are told once at the end.
    """
    here = present.select("node", F.lit(True).alias("here")).distinct()
    at = lambda c: here.select(F.col("node").alias(c), F.col("here").alias(f"{c}_here"))
    marked = edges.select("src", "dst").where(F.col("src") != F.col("dst")).join(at("dst"), "dst", "left").join(at("src"), "src", "left")
    marked = saved(marked.select("src", "dst", F.coalesce("src_here", F.lit(False)).alias("begins"), F.coalesce("dst_here", F.lit(False)).alias("here")), "splice-edges", "zstd")
    front, onward = marked.where("begins").select("src", "dst", "here"), marked.where("not begins").select("src", "dst", "here")
    done = front.where("here").select("src", "dst")
    seen = None
    while True:
        step = front.where("not here").select(F.col("src").alias("start"), F.col("dst").alias("src")).distinct()
        if seen is not None:
            step = step.join(seen, ["start", "src"], "left_anti")
        step = saved(step, "splice-places")
        if step.isEmpty():
            break
        seen = step if seen is None else seen.union(step)
        front = saved(step.join(onward, "src").select(F.col("start").alias("src"), "dst", "here"), "splice-steps")
        done = done.union(front.where("here").select("src", "dst"))
    return done.where("src <> dst").distinct()


def reachable(edges: DataFrame, starts: DataFrame, hops: int | None = None) -> DataFrame:
    """(start, node, depth): every node reached from each start, by its least depth; starts are at 0.

    ``hops`` bounds the depth; without it the walk goes on until nothing new is reached. One join a hop, written to the shared folder;
    a node already reached is not walked again, so cycles end. The clean edges are written once.
    """
    seen = saved(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).where("node is not null").distinct(), "reached")
    front, clean, depth = seen, saved(clean_edges(edges), "reach-edges"), 0
    while hops is None or depth < hops:
        depth += 1
        step = front.join(clean, front["node"] == clean["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = saved(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def _passing(edges: DataFrame, starts: DataFrame) -> DataFrame | None:
    """(node, up): for every node that has one way in and is no start the nearest node before it that is none of these, null where there is none.

    Ups double their reach in every round; those that have not arrived after as many rounds as nodes have binary digits run in a circle, which
    no start reaches. None if no such node has a way out.
    """
    one = edges.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("up")).where("n = 1").select(F.col("dst").alias("node"), "up")
    up = saved(one.join(starts, "node", "left_anti"), "chain-ups")
    if up.join(edges.select(F.col("src").alias("node")), "node", "left_semi").isEmpty():
        return None
    passing = saved(up.select(F.col("node").alias("up")), "chain-passing")
    for _ in range(up.count().bit_length() // 2 + 1):
        if up.join(passing, "up", "left_semi").isEmpty():
            return up
        before, on = up, up
        for _ in range(2):
            over = on.select(F.col("node").alias("up"), F.col("up").alias("over"))
            on = on.join(over, "up", "left").select("node", F.coalesce("over", "up").alias("up"))
        up = saved(on, "chain-ups")
        dropped(before)
    circling = passing.withColumn("circling", F.lit(True))
    return up.join(circling, "up", "left").select("node", F.when(F.col("circling").isNull(), F.col("up")).alias("up"))


def _shortened(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Edges by which each start reaches what it reaches by ``edges``, those out of a node with one way in beginning at the node before it."""
    short = saved(clean_edges(edges), "start-edges")
    while (up := _passing(short, starts)) is not None:
        moved = short.join(up.select(F.col("node").alias("src"), "up", F.lit(True).alias("passing")), "src", "left")
        moved = moved.select(F.when(F.col("passing"), F.col("up")).otherwise(F.col("src")).alias("src"), "dst").where("src is not null and src <> dst")
        before, short = short, saved(moved.distinct(), "start-edges")
        dropped(before)
    return short


def all_starts(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, start): every start (node) that each reached node is reached from, itself included if it is one; along shortened chains."""
    starts = saved(starts.select("node").where("node is not null").distinct(), "starts")
    return reachable(_shortened(edges, starts), starts).select("node", "start")


def _walked(rows: pa.Table) -> pa.RecordBatch:
    """(group, node, n, value) of whole groups' edges (group, src, dst) and starts (group, src, value; without dst), walked all at once."""
    rows = rows.combine_chunks()
    group, ids = (pc.dictionary_encode(pa.chunked_array(parts)).combine_chunks() for parts in ([*rows.column(0).chunks], [*rows.column(1).chunks, *rows.column(2).chunks]))
    codes, n = pc.fill_null(ids.indices, 0).to_numpy().astype(np.int64), rows.num_rows
    begins = rows.column(2).is_null().to_numpy()
    of = group.indices.to_numpy().astype(np.int64) * len(ids.dictionary)
    known, place = np.unique(np.concatenate([of + codes[:n], (of + codes[n:])[~begins]]), return_inverse=True)
    src, dst, starts = place[:n][~begins], place[n:], place[:n][begins]
    order = np.argsort(src, kind="stable")
    dst, ends = dst[order], np.searchsorted(src[order], np.arange(len(known) + 1))
    front = seen = np.arange(len(starts)) * len(known) + starts  # a start and a node as one number
    while len(front):
        start, node = np.divmod(front, len(known))
        ways = ends[node + 1] - ends[node]
        nth = np.arange(ways.sum()) - np.repeat(np.cumsum(ways) - ways, ways)
        step = np.unique(np.repeat(start, ways) * len(known) + dst[np.repeat(ends[node], ways) + nth])
        front = np.setdiff1d(step, seen, assume_unique=True)
        seen = np.union1d(seen, front)
    start, node = np.divmod(seen, len(known))
    count, only = np.bincount(node, minlength=len(known)), np.bincount(node, weights=start, minlength=len(known)).astype(np.int64)
    reached = np.flatnonzero(count)
    values = rows.column(3).filter(pa.array(begins)).take(pa.array(np.where(count == 1, only, 0)[reached], mask=count[reached] != 1))
    found = [group.dictionary.take(pa.array(known[reached] // len(ids.dictionary))), ids.dictionary.take(pa.array(known[reached] % len(ids.dictionary))), pa.array(count[reached]), values]
    return pa.Table.from_arrays(found, names=["group", "node", "n", "value"]).combine_chunks().to_batches(max_chunksize=len(reached))[0]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_walked() over rows in order of their groups; the last group of a batch, SMALL rows at most, waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([*held, batch])
            last = np.flatnonzero(pc.not_equal(rows.column(0), rows.column(0)[-1]).to_numpy())
            cut = int(last[-1]) + 1 if len(last) else 0
            held = rows.slice(cut).to_batches()
            if cut:
                yield _walked(rows.slice(0, cut))
    if held:
        yield _walked(pa.Table.from_batches(held))


def counted_starts(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(group, node, n, value): how many starts (group, node, value) each reached node is reached from by edges (group, src, dst), itself
    included if it is one, and the value of the only one, null where there are several.

    Edges lead nowhere outside their group. Groups of up to SMALL edges and starts are dealt by group and walked where they lie, a batch of
    groups at once; larger ones go through all_starts(), over all of them at once, so no task ever holds one.
    """
    kind = {c: starts.schema[c].dataType.simpleString() for c in ("group", "node", "value")}
    first = starts.where("group is not null and node is not null").groupBy("group", F.col("node").alias("src")).agg(F.min("value").alias("value"))
    ways = edges.select("group", "src", "dst", F.lit(None).cast(kind["value"]).alias("value")).where("group is not null and src is not null and dst is not null")
    rows = saved(ways.unionByName(first.select("group", "src", F.lit(None).cast(kind["node"]).alias("dst"), "value")), "walk-rows")
    large = saved(rows.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select("group"), "large-groups")
    none = large.isEmpty()
    few = rows if none else rows.join(large, "group", "left_anti")
    dealt = few.repartition("group").sortWithinPartitions("group").select("group", "src", "dst", "value")
    found = dealt.mapInArrow(_walk, f"group {kind['group']}, node {kind['node']}, n long, value {kind['value']}")
    if none:
        return found
    many, key = rows.join(large, "group", "left_semi"), lambda c: F.struct("group", F.col(c).alias("node"))
    reach = all_starts(many.where("dst is not null").select(key("src").alias("src"), key("dst").alias("dst")), many.where("dst is null").select(key("src").alias("node")))
    told = reach.groupBy("node").agg(F.count("*").alias("n"), F.min("start").alias("first")).select("node.group", "node.node", "n", F.when(F.col("n") == 1, F.col("first.node")).alias("src"))
    return found.unionByName(told.join(many.where("dst is null").select("group", "src", "value"), ["group", "src"], "left").select("group", "node", "n", "value"))


def sole_starts(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, first, last): the smallest and the largest start (node) that each reached node is reached from, itself included if it is one.

    They are equal where one start alone reaches a node. Instead of all starts of all nodes two a node are carried. A node with one way in
    is reached by what reaches the node before it, so its ways out may begin there instead: chains become single steps (one of 2,000
    nodes in 11 rounds), and ways that part and meet again become one, which makes new chains. What is left, where ways of different
    origin meet, is walked a step at a time, and only nodes whose starts have changed walk on. Cycles end; nodes that no start reaches
    are left out.
    """
    starts = saved(starts.select("node").where("node is not null").distinct(), "starts")
    short = _shortened(edges, starts)
    known = saved(starts.select("node", F.col("node").alias("first"), F.col("node").alias("last"), F.lit(True).alias("new")), "sole-starts")
    while not known.where("new").isEmpty():
        told = known.where("new").select(F.col("node").alias("src"), "first", "last").join(short, "src")
        told = told.groupBy(F.col("dst").alias("node")).agg(F.min("first").alias("f"), F.max("last").alias("l"))
        both = known.join(told, "node", "full_outer").select("node", F.least("first", "f").alias("a"), F.greatest("last", "l").alias("b"), "first", "last")
        same = F.col("a").eqNullSafe(F.col("first")) & F.col("b").eqNullSafe(F.col("last"))
        before, known = known, saved(both.select("node", F.col("a").alias("first"), F.col("b").alias("last"), (~same).alias("new")), "sole-starts")
        dropped(before)
    return known.select("node", "first", "last")


def flipped(edges: DataFrame, kinds: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges (id, src, dst, verb) with the ends swapped where only the reverse fits the rules (verb, src_kind, dst_kind)."""
    s = kinds.select(F.col("node").alias("src"), F.col("kind").alias("sk"))
    d = kinds.select(F.col("node").alias("dst"), F.col("kind").alias("dk"))
    typed = edges.join(s, "src", "left").join(d, "dst", "left")
    fits = typed.join(rules.select("verb", F.col("src_kind").alias("sk"), F.col("dst_kind").alias("dk"), F.lit(True).alias("as_is")), ["verb", "sk", "dk"], "left")
    turns = fits.join(rules.select("verb", F.col("src_kind").alias("dk"), F.col("dst_kind").alias("sk"), F.lit(True).alias("turned")), ["verb", "sk", "dk"], "left")
    swap = F.col("as_is").isNull() & F.coalesce("turned", F.lit(False))
    return turns.select("id", F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("dst"), "verb", swap.alias("was_flipped"))


def section_ranges(raw: DataFrame) -> DataFrame:
    """Overlapping line ranges (doc, first, last, kind) made disjoint: inverted ones turned, earlier ones win, later ones cut."""
    turned = raw.select("doc", F.least("first", "last").alias("first"), F.greatest("first", "last").alias("last"), "kind")
    order = Window.partitionBy("doc").orderBy("first", "last", "kind").rowsBetween(Window.unboundedPreceding, -1)
    cut = turned.withColumn("first", F.greatest("first", F.coalesce(F.max("last").over(order) + 1, F.col("first"))))
    return cut.where("first <= last")


def core(edges: DataFrame) -> DataFrame:
    """Edges that stay when nodes without a way in or without a way out are taken away until there are none; none stay where there is no cycle."""
    left, before = edges, -1
    while True:
        into, out = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        kept = saved(left.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"), "core-edges")
        dropped(left)
        left, n = kept, kept.count()
        if n in (0, before):
            return left
        before = n


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the largest node that each node of ``edges`` is reached from, itself included."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    colours = saved(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("new")), "colours")
    while not colours.where("new").isEmpty():
        told = colours.where("new").select(F.col("node").alias("src"), "colour").join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("told"))
        better = F.coalesce(F.col("told") > F.col("colour"), F.lit(False))
        step = saved(colours.join(told, "node", "left").select("node", F.when(better, F.col("told")).otherwise(F.col("colour")).alias("colour"), better.alias("new")), "colours")
        dropped(colours)
        colours = step
    return colours.select("node", "colour")


def cyclic(edges: DataFrame) -> DataFrame:
    """The nodes that reach themselves: those on loops and in strongly connected components of two nodes or more.

    What cannot be on a cycle is taken away first. In each round the largest node that reaches a node colours it; walking
    back from that node inside its colour gives one whole component per colour, and the rest is searched again.
    """
    found = edges.where(F.col("src") == F.col("dst")).select(F.col("src").alias("node"))
    left = core(clean_edges(edges))
    while not left.isEmpty():
        colours = _coloured(left)
        inside = left.join(colours.select(F.col("node").alias("src"), "colour"), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst")
        inside = saved(inside.where("colour = other").select("src", "dst", "colour"), "coloured-edges")
        front = saved(inside.where("src = colour").select(F.col("src").alias("node"), "colour").distinct(), "cycle-members")
        members = front
        while not front.isEmpty():
            back = inside.join(front.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            front = saved(back.join(members, ["node", "colour"], "left_anti"), "cycle-members")
            members = members.union(front)
        grown = members.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")
        found = saved(found.union(members.join(grown, "colour", "left_semi").select("node")).distinct(), "cycle-nodes")
        gone = colours.where("node = colour").select("node").union(members.select("node")).distinct()
        rest = left.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
        left = core(rest.select("src", "dst"))
    return found.distinct()


def path_elements(paths: DataFrame) -> DataFrame:
    """(kind, a, b): the nodes (b null) and the edges, whichever way they go, of paths (path: array)."""
    steps = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda k: F.struct(F.element_at("path", k).alias("x"), F.element_at("path", k + 1).alias("y")))).alias("s")).select("s.*")
    nodes = paths.select(F.explode("path").alias("a")).distinct()
    edges = steps.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    kind = paths.schema["path"].dataType.elementType
    return nodes.select(F.lit("node").alias("kind"), "a", F.lit(None).cast(kind).alias("b")).unionByName(edges.select(F.lit("edge").alias("kind"), "a", "b"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, hops: int = 10, most: int = 100) -> DataFrame:
    """(src, dst, path) for all shortest undirected paths between each pair, ``hops`` long at most.

    Depths are found first, a row per start and node, from the side of the pairs that has fewer different nodes: one end that all
    share is searched from once. Paths are then walked back from the other side along falling depths
    alone, so no dead end is ever carried as a path. Of a pair's paths the ``most`` first by order are told, each step
    keeping the ``most`` first, which by their order are those of the whole.
    """
    ways = saved(both_ways(edges).select(F.col("src").alias("at"), F.col("dst").alias("next")), "ways")
    asked = saved(pairs.select("src", "dst").where("src <> dst").distinct(), "asked-pairs")
    sides = asked.agg(F.count_distinct("src").alias("src"), F.count_distinct("dst").alias("dst")).first()
    near, far = ("dst", "src") if sides["dst"] < sides["src"] else ("src", "dst")
    depths = saved(asked.select(F.col(near).alias("start"), F.col(near).alias("node"), F.lit(0).alias("depth")).distinct(), "depths")
    front = depths
    for depth in range(1, hops + 1):
        open_ = asked.join(depths.select(F.col("start").alias(near), F.col("node").alias(far)), [near, far], "left_anti").select(F.col(near).alias("start")).distinct()
        step = front.join(open_, "start", "left_semi").join(ways, front["node"] == ways["at"]).select("start", F.col("next").alias("node")).distinct()
        front = saved(step.join(depths.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "depths")
        if front.isEmpty():
            break
        depths = depths.unionByName(front)
    ends = asked.join(depths, (F.col(near) == F.col("start")) & (F.col(far) == F.col("node")))
    paths = ends.select("src", "dst", F.col(far).alias("at"), F.array(far).alias("path"), "depth")
    done = paths.where("depth = 0").select("src", "dst", "path")
    for _ in range(hops):
        earlier = depths.select(F.col("start").alias(near), F.col("node").alias("next"), (F.col("depth") + 1).alias("depth"))
        back = paths.join(ways, "at").join(earlier, [near, "next", "depth"])
        longer = F.concat(F.array("next"), F.col("path")) if near == "src" else F.concat(F.col("path"), F.array("next"))
        back = back.select("src", "dst", F.col("next").alias("at"), longer.alias("path"), (F.col("depth") - 1).alias("depth"))
        rank = F.row_number().over(Window.partitionBy("src", "dst", "at").orderBy("path"))
        paths = saved(back.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank"), "paths")
        if paths.isEmpty():
            break
        done = done.unionByName(paths.where("depth = 0").select("src", "dst", "path"))
    rank = F.row_number().over(Window.partitionBy("src", "dst").orderBy("path"))
    return done.withColumn("rank", rank).where(F.col("rank") <= most).select("src", "dst", "path")
