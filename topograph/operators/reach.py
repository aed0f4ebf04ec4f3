"""What many nodes reach at once: 64 of them in the bits of one number for each node."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.functions.scratch import materialize
from topograph.operators.components import connected_components

#: Rounds after which what was reached so far is written as one table.
TOGETHER = 8
#: Rounds after which components that still go on are given to tasks, up to so many edges each; seeds times nodes that a task holds at once.
DEEP, EDGES, CELLS = 8, 200_000, 1 << 26


@dataclass
class Reached:
    """seeds (id, g, bit): where each seed stands; sets (node, g, bits): the seeds of group g that reach a node, or that it is; depth: rounds until nothing new was reached."""

    seeds: DataFrame
    sets: DataFrame
    depth: int

    def pairs(self, nodes: DataFrame) -> DataFrame:
        """(origin, node) for the nodes (id) asked for, without those of a node and itself."""
        asked = self.sets.join(nodes.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
        bits = asked.select("node", "g", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("bits", b) == 1)).alias("bit"))
        return bits.join(self.seeds, ["g", "bit"]).where("id <> node").select(F.col("id").alias("origin"), "node")

    def counts(self) -> DataFrame:
        """(id, reached): how many other nodes each seed reaches. Each task sums 64 counts a group, so only those are shuffled."""
        each = self.sets.groupBy("g").agg(*(F.sum(F.getbit("bits", F.lit(b)).cast("long")).alias(f"n{b}") for b in range(64)))
        rows = each.select("g", F.inline(F.array(*(F.struct(F.lit(b).alias("bit"), F.col(f"n{b}").alias("n")) for b in range(64)))))
        return self.seeds.join(rows, ["g", "bit"]).select("id", (F.col("n") - 1).alias("reached"))


def _levels(src: np.ndarray, dst: np.ndarray, n: int, starts: np.ndarray, max_depth: int | None) -> tuple[np.ndarray, int]:
    """(reached, depth): which of n nodes each of starts reaches, itself included, breadth first from all of them at once, and the levels that it took."""
    order = np.argsort(src, kind="stable")
    to, first = dst[order], np.searchsorted(src[order], np.arange(n + 1))
    reached = np.zeros(len(starts) * n, bool)
    at = np.arange(len(starts)) * n + starts  # a start and a node in one number
    reached[at] = True
    depth = 0
    while max_depth is None or depth < max_depth:
        node = at % n
        many = first[node + 1] - first[node]
        ends = np.cumsum(many)
        if not len(ends) or not ends[-1]:
            break
        step = to[np.arange(ends[-1]) + np.repeat(first[node] - ends + many, many)] + np.repeat(at - node, many)
        at = np.unique(step[~reached[step]])
        if not len(at):
            break
        reached[at] = True
        depth += 1
    return reached.reshape(len(starts), n), depth


def _in_tasks(inside: DataFrame, seeds: DataFrame, max_depth: int | None, sets: bool) -> DataFrame:
    """(id, g, bit, bits, depth) of the components of inside (component, number, src, dst): a row with a bit for each of seeds (component, id), and if sets is set one with bits for each node and group that reaches it.

    A task holds the edges of one component and some of its seeds. Groups are
    of one component each, and their numbers are below 0.
    """
    kind = inside.schema["src"].dataType.simpleString()
    lists = inside.groupBy("component", "number").agg(F.collect_list(F.struct("src", "dst")).alias("e"))
    starts = seeds.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("starts"))
    width = F.greatest(F.lit(64), F.floor(F.lit(CELLS) / (F.size("e") + 1) / 64).cast("int") * 64)
    dealt = lists.join(starts, "component").withColumn("width", width)
    dealt = dealt.select("number", "width", F.explode(F.sequence(F.lit(0), F.floor((F.size("starts") - 1) / F.col("width")).cast("int"))).alias("slice"), "starts", F.col("e.src").alias("src"), F.col("e.dst").alias("dst"))
    dealt = dealt.select("number", "src", "dst", (F.col("slice") * F.col("width") / 64).cast("long").alias("group"), F.slice("starts", F.col("slice") * F.col("width") + 1, F.col("width")).alias("starts"))
    n = int(inside.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number, src, dst, group, mine in zip(pdf["number"], pdf["src"], pdf["dst"], pdf["group"], pdf["starts"], strict=True):
                nodes, places = np.unique(np.concatenate([src, dst]), return_inverse=True)
                reached, depth = _levels(places[: len(src)], places[len(src) :], len(nodes), np.searchsorted(nodes, mine), max_depth)
                k = np.arange(len(mine))
                names = -1 - ((int(number) << 24) + group + np.arange(-(-len(mine) // 64)))
                yield pd.DataFrame({"id": mine, "g": names[k // 64], "bit": pd.array(k % 64, "Int32"), "bits": pd.array([None] * len(k), "Int64"), "depth": depth})
                for i in range(len(names)) if sets else ():
                    eight = np.zeros((8, len(nodes)), np.uint8)
                    packed = np.packbits(reached[64 * i : 64 * i + 64], axis=0, bitorder="little")
                    eight[: len(packed)] = packed
                    bits = np.ascontiguousarray(eight.T).view("<i8").ravel()
                    some = np.flatnonzero(bits)
                    yield pd.DataFrame({"id": nodes[some], "g": names[i], "bit": pd.array([None] * len(some), "Int32"), "bits": pd.array(bits[some], "Int64"), "depth": depth})

    return dealt.repartition(n, "number", "group").mapInPandas(run, f"id {kind}, g long, bit int, bits long, depth int")


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, sets: bool = True) -> Reached:
    """What each seed (id) reaches along edges, breadth first: every round sends on the bits that are new.

    The rows are nodes times groups of 64 seeds, not nodes times seeds; the
    rounds are those of the longest of the shortest paths, or max_depth. Weak
    components that go on after DEEP rounds and have at most EDGES edges are
    searched by tasks instead, each by one or more of them. Without sets only
    the depth is whole.
    """
    e = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    # numbers are dense within a partition, so groups are full but for the last of each; they hold once written
    number = seeds.select("id").distinct().withColumn("n", F.monotonically_increasing_id())
    placed = materialize(number.select("id", F.shiftright("n", 6).alias("g"), (F.col("n") % 64).cast("int").alias("bit")), "seeds")
    seen = frontier = materialize(placed.groupBy(F.col("id").alias("node"), "g").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")), "reach")
    depth = most = 0
    done: DataFrame | None = None
    while max_depth is None or depth < max_depth:
        sent = frontier.join(e, frontier["node"] == e["src"]).groupBy(F.col("dst").alias("node"), "g").agg(F.bit_or("bits").alias("bits"))
        known = seen.groupBy("node", "g").agg(F.bit_or("bits").alias("known"))
        new = sent.join(known, ["node", "g"], "left").select("node", "g", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long")))).alias("bits")).where("bits <> 0")
        frontier = materialize(new, "reach")
        if frontier.isEmpty():
            break
        depth += 1
        seen = seen.union(frontier)
        if depth % TOGETHER == 0:
            seen = materialize(seen.groupBy("node", "g").agg(F.bit_or("bits").alias("bits")), "reach")
        if depth == DEEP:
            parts = materialize(connected_components(e), "parts")
            sizes = e.join(parts, e["src"] == parts["id"]).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
            going = frontier.select(F.col("node").alias("id")).distinct().join(parts, "id").select("component").distinct()
            deep = materialize(sizes.where(F.col("n") <= EDGES).join(going, "component", "left_semi").select("component").withColumn("number", F.monotonically_increasing_id()), "deep")
            if deep.isEmpty():
                continue
            members = materialize(parts.join(deep, "component"), "members")
            inside = e.join(members, e["src"] == members["id"]).select("component", "number", "src", "dst")
            done = materialize(_in_tasks(inside, members.join(placed, "id").select("component", "id"), max_depth, sets), "done")
            most = done.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
            rest = lambda df, c: materialize(df.join(members.select(F.col("id").alias(c)), c, "left_anti"), "reach")
            seen, frontier, placed = rest(seen, "node"), rest(frontier, "node"), rest(placed, "id").unionByName(done.where("bit is not null").select("id", "g", "bit"))
            if frontier.isEmpty():
                break
    whole = seen.groupBy("node", "g").agg(F.bit_or("bits").alias("bits"))
    if done is not None:
        whole = whole.unionByName(done.where("bits is not null").select(F.col("id").alias("node"), "g", "bits"))
    return Reached(placed, materialize(whole, "reach"), max(depth, most))
