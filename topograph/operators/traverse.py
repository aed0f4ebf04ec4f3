"""Breadth-first operators: one join of the frontier with the edges each round, what is new going on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.functions.scratch import materialize
from topograph.operators.reach import reach


#: Rounds after which what was found so far is written as one table.
TOGETHER = 8


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(reversed_edges(edges)).distinct()


def distances(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, closed: DataFrame | None = None) -> DataFrame:
    """(origin, node, distance), distance > 0, of what each origin (id) of seeds reaches along edges.

    An origin is in its own result only if a cycle leads back, which this
    leaves out. Nodes of closed (id) are reached but not gone through. Rounds
    end when nothing new is found or at max_depth.
    """
    e = edges.select("src", "dst").distinct()
    frontier = materialize(seeds.select(F.col("id").alias("origin"), F.col("id").alias("node"), F.lit(0).alias("distance")).distinct(), "frontier")
    seen = frontier
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(e, frontier["node"] == e["src"]).select("origin", F.col("dst").alias("node")).distinct()
        new = materialize(step.join(seen, ["origin", "node"], "left_anti").withColumn("distance", F.lit(depth)), "frontier")
        if new.isEmpty():
            break
        seen = seen.union(new)
        if depth % TOGETHER == 0:  # else round d would read d tables
            seen = materialize(seen, "seen")
        frontier = new if closed is None else new.join(closed.select(F.col("id").alias("node")), "node", "left_anti").select("origin", "node", "distance")
    return seen.where("distance > 0")


def chain_steps(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(origin, node, distance, rank, before) of what each origin reaches: before is the node that comes before it on the first, in lexicographic order, of the shortest paths.

    Rows have a constant width: of the paths to nodes of one distance only
    their order is kept, as rank, and the first path to a node goes over the
    one of least rank before it. A sort of the whole round numbers them, so an
    origin that reaches very many nodes is no group of one task.
    """
    e = edges.select("src", "dst").distinct()
    start = F.col("id")
    frontier = materialize(seeds.select(start.alias("origin"), start.alias("node"), F.lit(0).alias("distance"), F.lit(0).cast("long").alias("rank"), F.nullif(start, start).alias("before")).distinct(), "chains")
    seen = frontier
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(e, frontier["node"] == e["src"]).select("origin", F.col("dst").alias("node"), F.struct("rank", F.col("node").alias("before")).alias("last"))
        best = step.groupBy("origin", "node").agg(F.min("last").alias("last")).join(seen, ["origin", "node"], "left_anti")
        numbered = best.orderBy("last.rank", "node", "origin").withColumn("rank", F.monotonically_increasing_id())
        new = materialize(numbered.select("origin", "node", F.lit(depth).alias("distance"), "rank", F.col("last.before").alias("before")), "chains")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        if depth % TOGETHER == 0:
            seen = materialize(seen, "seen")
        frontier = new
    return seen


def chain_paths(steps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(origin, node, distance, path) of the wanted (origin, node) of chain_steps, walked back one step a round; others are never put together."""
    at = materialize(steps.join(wanted.select("origin", "node").distinct(), ["origin", "node"]).select("origin", "node", "distance", F.col("distance").alias("k"), F.col("node").alias("at"), "before"), "walk")
    parts, rounds = at, 0
    back = steps.select("origin", F.col("node").alias("before"), F.col("before").alias("next"))
    while True:
        rounds += 1
        at = materialize(at.where("k > 0").join(back, ["origin", "before"]).select("origin", "node", "distance", (F.col("k") - 1).alias("k"), F.col("before").alias("at"), F.col("next").alias("before")), "walk")
        if at.isEmpty():
            break
        parts = parts.unionByName(at)
        if rounds % TOGETHER == 0:
            parts = materialize(parts, "walked")
    path = F.transform(F.array_sort(F.collect_list(F.struct("k", "at"))), lambda x: x["at"])
    return parts.groupBy("origin", "node", "distance").agg(path.alias("path"))


def shortest_chains(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(origin, node, distance, path): of the shortest paths from origin to node the first in lexicographic order."""
    steps = chain_steps(edges, seeds, max_depth)
    return chain_paths(steps, steps.where("distance > 0"))


def ego(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Edges among the nodes within hops of the seeds, whichever way edges point."""
    near = distances(undirected(edges), seeds, hops).select(F.col("node").alias("id")).union(seeds.select("id")).distinct()
    near = materialize(near, "ego")
    inside = edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi")
    return inside.join(near.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst").distinct()


def callers(edges: DataFrame, target: DataFrame, max_depth: int = 10, transitive: bool = True) -> DataFrame:
    """(caller, distance) of the symbols that call those of target, within max_depth calls."""
    found = distances(reversed_edges(edges), target, max_depth if transitive else 1)
    return found.groupBy(F.col("node").alias("caller")).agg(F.min("distance").alias("distance"))


def covers(edges: DataFrame, tests: DataFrame, sources: DataFrame) -> DataFrame:
    """(test, source) pairs with a path from test to source."""
    found = reach(reversed_edges(edges), sources).pairs(tests)
    return found.select(F.col("node").alias("test"), F.col("origin").alias("source"))


def max_call_depth(edges: DataFrame) -> DataFrame:
    """(max_depth): the longest of the shortest call chains, counted in symbols; 0 without calls."""
    spark = edges.sparkSession
    plain = edges.where("src <> dst")
    starts = plain.select(F.col("src").alias("id")).distinct()
    depth = reach(plain, starts, sets=False).depth
    return spark.range(1).select(F.lit(depth + 1 if depth else 0).cast("long").alias("max_depth"))
