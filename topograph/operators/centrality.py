"""Betweenness by Brandes' accumulation, of all sources, or of as many as an error needs: in tasks that have the whole graph, or level by level over (source, node) rows if it is too large."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.functions.scratch import materialize
from topograph.operators.whole_graph import WholeGraph, sums, whole_graph


def _flows(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(v, delta) for each start (id) and each other node that it reaches: the shares of the shortest paths from it that v stands within."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    level = materialize(starts.select("id").distinct().select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths"), F.lit(0).alias("level")), "level")
    levels = [level]
    seen = level.select("s", "v")
    while True:
        last = levels[-1]
        step = last.join(e, last["v"] == e["src"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        new = materialize(step.join(seen, ["s", "v"], "left_anti").withColumn("level", F.lit(len(levels))), "level")
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.union(new.select("s", "v"))
    gathered: list[DataFrame] = []
    ahead: DataFrame | None = None  # (s, v, share) of the level after
    for rows in reversed(levels):
        if ahead is None:
            have = rows.withColumn("delta", F.lit(0.0))
        else:
            # forward again, so that hubs with many edges in cost no more than they did on the way there
            back = rows.select("s", "v").join(e, F.col("v") == e["src"]).select("s", "v", F.col("dst").alias("w")).join(ahead, ["s", "w"]).groupBy("s", "v").agg(F.sum("share").alias("share"))
            have = rows.join(back, ["s", "v"], "left").withColumn("delta", F.col("paths") * F.coalesce("share", F.lit(0.0)))
        have = materialize(have.select("s", "v", "paths", "delta"), "delta")
        gathered.append(have.where("s <> v").select("v", "delta"))
        ahead = have.select("s", F.col("v").alias("w"), ((1 + F.col("delta")) / F.col("paths")).alias("share"))
    flow = gathered[0]
    for x in gathered[1:]:
        flow = flow.union(x)
    return flow


def _sums(graph: WholeGraph | None, edges: DataFrame, starts: DataFrame, scale: float = 1.0) -> DataFrame:
    """(id, s1, s2): sums of each node's shares times scale, and of their squares, over the sources starts."""
    if graph is not None:
        return sums(graph, starts, scale)
    share = F.col("delta") * scale
    return _flows(edges, starts).groupBy(F.col("v").alias("id")).agg(F.sum(share).alias("s1"), F.sum(share * share).alias("s2"))


def betweenness(nodes: DataFrame, edges: DataFrame, graph: WholeGraph | None = None, whole: int | None = None) -> DataFrame:
    """(id, betweenness), directed and divided by (n - 1)(n - 2), for every node; exact, in sources x nodes steps, which are rows where the graph has over `whole` edges. graph is that of nodes and edges if it was made before."""
    total = _sums(graph or whole_graph(nodes, edges, whole), edges, nodes.select("id")).select(F.col("id").alias("v"), F.col("s1").alias("delta"))
    n = nodes.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.join(total, nodes["id"] == total["v"], "left").select("id", (F.coalesce("delta", F.lit(0.0)) * scale).alias("betweenness"))


def estimated_betweenness(nodes: DataFrame, edges: DataFrame, error: float = 0.01, confidence: float = 0.95, batch: int = 256, seed: int = 0, graph: WholeGraph | None = None, whole: int | None = None) -> DataFrame:
    """(id, betweenness, error) for every node, from shortest paths of as many sources as it takes.

    Sources come in batches of about `batch`, drawn by a hash of their ids, none
    twice. After each batch every node has the mean and the variance of its
    shares so far, and from them a bound on its error (empirical Bernstein,
    for all nodes and batches at once): with the stated confidence no node is
    off by more than its `error`. Drawing ends when the largest is within the
    error asked for, or when all nodes have been sources: then all is exact and
    errors are 0, as they are with error=0. Nodes of even shares settle after
    few sources, whatever their number. Each batch takes batch x nodes steps,
    rows where the graph has over `whole` edges. graph is that of nodes and
    edges if it was made before.
    """
    n = nodes.count()
    if n <= 2:
        return nodes.select("id", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("error"))
    graph = graph or whole_graph(nodes, edges, whole)
    buckets = max(1, -(-n // batch))
    drawn = nodes.select("id", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(buckets)).alias("turn"))
    sums: DataFrame | None = None
    k = 0
    for turn in range(buckets):
        starts = materialize(drawn.where(F.col("turn") == turn).select("id"), "starts")
        k += starts.count()
        new = _sums(graph, edges, starts, 1 / (n - 2))
        sums = materialize(new if sums is None else sums.union(new).groupBy("id").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2")), "sums")
        if k < 2 and turn + 1 < buckets:
            continue
        log = math.log(4 * n * (turn + 1) * (turn + 2) / (1 - confidence))
        variance = F.greatest((F.col("s2") - F.col("s1") * F.col("s1") / k) / max(1, k - 1), F.lit(0.0))
        bound = F.lit(0.0) if turn + 1 == buckets else (F.sqrt(variance * (2 * log / k)) + 7 * log / (3 * (k - 1))) * (n / (n - 1))
        # a node that no path went through yet has the variance 0
        least = 0.0 if turn + 1 == buckets else 7 * log / (3 * (k - 1)) * (n / (n - 1))
        worst = max(least, sums.agg(F.coalesce(F.max(bound), F.lit(0.0))).first()[0])
        if worst <= error or turn + 1 == buckets:
            break
    scale = n / (n - 1) / max(1, k)
    return nodes.select("id").join(sums, "id", "left").select("id", (F.coalesce("s1", F.lit(0.0)) * scale).alias("betweenness"), F.coalesce(F.when(F.col("s1").isNotNull(), bound), F.lit(least)).alias("error"))
