"""Strongly connected components, simple cycles and what is reported of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topograph.functions.scratch import materialize
from topograph.operators.components import connected_components


def _reach_labels(edges: DataFrame, order: Column) -> DataFrame:
    """(id, f, b) of every node: of the nodes that reach it, and of those it reaches, itself included, the first by order, as structs (o, id).

    A node's label takes over the label of the node it names: what reaches that
    node reaches this one too. So labels travel in jumps, and the rounds grow
    with the logarithm of the longest path.
    """
    nodes = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    own = F.struct(order.alias("o"), "id")
    labels = materialize(nodes.select("id", own.alias("f"), own.alias("b"), F.lit(True).alias("changed")), "labels")
    nothing = F.lit(None).cast(labels.schema["f"].dataType)
    no = F.lit(None).cast(labels.schema["id"].dataType)
    forth = F.array(F.struct(F.col("src").alias("near"), F.col("dst").alias("far"), F.lit(True).alias("ahead")), F.struct(F.col("dst").alias("near"), F.col("src").alias("far"), F.lit(False).alias("ahead")))
    both = edges.select(F.inline(forth))
    while True:
        at = labels.select(F.col("id").alias("near"), F.col("f").alias("f_"), F.col("b").alias("b_"))
        # a node tells its label along edges, and to the nodes whose label names it
        named = labels.where("f.id <> id").select(F.col("f.id").alias("near"), F.col("id").alias("far"), F.lit(True).alias("ahead")).union(labels.where("b.id <> id").select(F.col("b.id").alias("near"), F.col("id").alias("far"), F.lit(False).alias("ahead")))
        told = both.union(named).join(at, "near").select(F.col("far").alias("id"), F.when(F.col("ahead"), F.col("f_")).otherwise(nothing).alias("f"), F.when(~F.col("ahead"), F.col("b_")).otherwise(nothing).alias("b"), no.alias("f_id"), no.alias("b_id"))
        every = labels.select("id", "f", "b", F.col("f.id").alias("f_id"), F.col("b.id").alias("b_id")).union(told).groupBy("id").agg(F.min("f").alias("f"), F.min("b").alias("b"), F.max("f_id").alias("f_id"), F.max("b_id").alias("b_id"))
        labels = materialize(every.select("id", "f", "b", ((F.col("f.id") != F.col("f_id")) | (F.col("b.id") != F.col("b_id"))).alias("changed")), "labels")
        if labels.where("changed").isEmpty():
            return labels.select("id", "f", "b")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges of nodes that have one in and one out."""
    ins, outs = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return materialize(edges.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"), "scc")


def _labelled(edges: DataFrame) -> DataFrame | None:
    """(id, label) of the nodes of strong components, some of one node; None if there are no edges left to look at."""
    left, found, turn = edges, None, 0
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            return found
        labels = _reach_labels(left, F.lit(0).cast("long") if not turn else F.xxhash64(F.lit(turn), "id"))
        turn += 1
        whole = labels.where("f.id = b.id").select("id", F.col("f.id").alias("label"))
        found = whole if found is None else found.union(whole)
        rest = labels.where("f.id <> b.id").select("id", F.col("f.id").alias("f"), F.col("b.id").alias("b"))
        one, two = rest.select(F.col("id").alias("src"), "f", "b"), rest.select(F.col("id").alias("dst"), F.col("f").alias("f2"), F.col("b").alias("b2"))
        left = left.join(one, "src").join(two, "dst").where("f = f2 and b = b2").select("src", "dst")


def _one_pass(out: dict) -> Iterator[list]:
    """The strong components of two nodes or more of a graph, by one depth-first search (Tarjan 1972)."""
    number: dict = {}
    low: dict = {}
    open_: list = []
    inside: set = set()
    for start in out:
        if start in number:
            continue
        number[start] = low[start] = len(number)
        open_.append(start)
        inside.add(start)
        walk = [(start, iter(out[start]))]
        while walk:
            v, rest = walk[-1]
            for w in rest:
                if w not in number:
                    number[w] = low[w] = len(number)
                    open_.append(w)
                    inside.add(w)
                    walk.append((w, iter(out.get(w, ()))))
                    break
                if w in inside:
                    low[v] = min(low[v], number[w])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
                if low[v] == number[v]:
                    at = len(open_) - 1
                    while open_[at] != v:
                        at -= 1
                    found = open_[at:]
                    del open_[at:]
                    inside.difference_update(found)
                    if len(found) > 1:
                        yield found


def _components_in_a_task(edges: DataFrame) -> DataFrame:
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict = {}
        for pdf in batches:
            for v, w in zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True):
                out.setdefault(v, []).append(w)
        found = [(v, min(nodes)) for nodes in _one_pass(out) for v in nodes]
        yield pd.DataFrame(found, columns=["id", "component"])

    return edges.repartition(1).mapInPandas(run, f"id {kind}, component {kind}")


#: Edges up to which a graph's strong components are found by one task.
SMALL = 50_000


def strong_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, component) of every node on a cycle of two nodes or more; component is its least id.

    A graph of at most `small` edges is searched by one task, as dozens of jobs
    cost more; larger ones in rounds over all, with the same result.
    Chains of nodes with one edge in and one out become single edges first, by
    weak components, in rounds logarithmic in their length; a chain without an
    end is a ring. The nodes of a component share what reaches them and what
    they reach: each round labels every node with the first node that reaches
    it and the first that it reaches, in an order drawn anew each time (at
    first that of ids). Where both are one node, that is its component. Edges
    between nodes of different labels lie in none and go, as do those of nodes
    without an edge in or out.
    """
    plain = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "scc")
    if plain.count() <= small:
        return materialize(_components_in_a_task(plain), "components")
    all_ = _trimmed(plain)
    one_in, one_out = all_.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")), all_.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    through = materialize(one_in.where("n = 1").select("id").join(one_out.where("n = 1").select("id"), "id"), "through")
    by = lambda c: through.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_in"))
    marked = materialize(all_.join(by("src"), "src", "left").join(by("dst"), "dst", "left"), "marked")
    inner = marked.where("src_in and dst_in").select("src", "dst")
    if inner.limit(LONG).count() < LONG:
        found = _labelled(all_)
    else:
        chain = materialize(connected_components(inner).select("id", F.col("component").alias("chain")), "chain")
        enters = marked.where("src_in is null and dst_in").join(chain, F.col("dst") == F.col("id")).select("chain", F.col("src").alias("u"))
        leaves = marked.where("src_in and dst_in is null").join(chain, F.col("src") == F.col("id")).select("chain", F.col("dst").alias("w"))
        ends = materialize(enters.join(leaves, "chain"), "ends")
        single = chain.select(F.col("id").alias("src"), F.lit(True).alias("hit"))
        outside = marked.join(single, "src", "left").where("hit is null").select("src", "dst").join(single.select(F.col("src").alias("dst"), "hit"), "dst", "left").where("hit is null").select("src", "dst")
        found = _labelled(outside.union(ends.where("u <> w").select(F.col("u").alias("src"), F.col("w").alias("dst"))).distinct())
        nothing = chain.select("id", F.col("id").alias("label")).limit(0)
        found = materialize(nothing if found is None else found, "labels")
        known = lambda c: found.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
        through_ends = ends.join(known("u"), "u", "left").join(known("w"), "w", "left").where("u = w or u_label = w_label").select("chain", "u", F.coalesce("u_label", "u").alias("label"))
        through_ends = materialize(through_ends, "closed")
        rings = chain.join(ends, "chain", "left_anti").select("id", F.col("chain").alias("label"))
        chains = chain.join(through_ends, "chain").select("id", "label").union(through_ends.select(F.col("u").alias("id"), "label")).union(rings)
        found = found.union(chains).distinct()
    if found is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    large = found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("component")).where("n > 1")
    return found.join(large, "label").select("id", "component")


#: Fewer edges between nodes of one edge in and one out aren't worth the rounds that contract them.
LONG = 16
#: Edges of a component up to which its cycles are found by tasks that hold them all; roots are dealt among so many tasks.
TOGETHER, SLICES = 200_000, 64


def _within(out: dict, root: object) -> dict:
    """The edges among nodes from root on that lie on a way from root and back to it."""
    back: dict = {}
    seen, stack = {root}, [root]
    while stack:
        v = stack.pop()
        for w in out.get(v, ()):
            if w >= root:
                back.setdefault(w, []).append(v)
                if w not in seen:
                    seen.add(w)
                    stack.append(w)
    home, stack = {root}, [root]
    while stack:
        for v in back.get(stack.pop(), ()):
            if v not in home:
                home.add(v)
                stack.append(v)
    return {v: [w for w in out.get(v, ()) if w in home] for v in home}


def _circuits(out: dict, root: object) -> Iterator[list]:
    """Cycles whose least node is root. A node from which root can't be reached past the path is blocked until a node that it waits for is left."""
    out = _within(out, root)
    if len(out) < 2:
        return
    path, blocked, waits = [root], {root}, {}
    stack = [(root, iter(out[root]), [False])]
    while stack:
        v, rest, closed = stack[-1]
        for w in rest:
            if w == root:
                closed[0] = True
                yield list(path)
            elif w not in blocked:
                path.append(w)
                blocked.add(w)
                stack.append((w, iter(out[w]), [False]))
                break
        else:
            stack.pop()
            path.pop()
            if closed[0]:
                if stack:
                    stack[-1][2][0] = True
                free = [v]
                while free:
                    u = free.pop()
                    if u in blocked:
                        blocked.discard(u)
                        free += waits.pop(u, ())
            else:
                for w in out[v]:
                    waits.setdefault(w, set()).add(v)


def _short_circuits(out: dict, root: object, longest: int) -> Iterator[list]:
    """Cycles of at most `longest` nodes whose least node is root; a path goes on only while the way back is short enough."""
    out = _within(out, root)
    back: dict = {}
    for v, ws in out.items():
        for w in ws:
            back.setdefault(w, []).append(v)
    home, level = {root: 0}, [root]
    while level and home[level[0]] < longest:
        following = []
        for w in level:
            for v in back.get(w, ()):
                if v not in home:
                    home[v] = home[w] + 1
                    following.append(v)
        level = following
    path, on = [root], {root}
    stack = [iter(out[root])]
    while stack:
        for w in stack[-1]:
            if w == root:
                if len(path) > 1:
                    yield list(path)
            elif w not in on and len(path) + home.get(w, longest) <= longest:
                path.append(w)
                on.add(w)
                stack.append(iter(out[w]))
                break
        else:
            stack.pop()
            on.discard(path.pop())


def _grown_cycles(inside: DataFrame, max_length: int | None) -> DataFrame:
    """Cycles by joining paths with edges, a round for each length: for components too large for a task."""
    paths = materialize(inside.where("dst > src").select(F.col("src").alias("root"), F.col("dst").alias("last"), F.array("src", "dst").alias("nodes")), "paths")
    closing = inside.select(F.col("src").alias("last"), F.col("dst").alias("root"))
    found = paths.join(closing, ["last", "root"], "left_semi").select("nodes")
    length = 2
    while not paths.isEmpty() and (max_length is None or length < max_length):
        length += 1
        grown = paths.join(inside, paths["last"] == inside["src"]).where("dst > root and not array_contains(nodes, dst)")
        paths = materialize(grown.select("root", F.col("dst").alias("last"), F.concat("nodes", F.array("dst")).alias("nodes")), "paths")
        found = found.union(paths.join(closing, ["last", "root"], "left_semi").select("nodes"))
    return found


def simple_cycles(edges: DataFrame, max_length: int | None = None, together: int = TOGETHER) -> DataFrame:
    """(nodes, length) of every simple cycle of two nodes or more, each once, from its least node on.

    Their number can be exponential; max_length bounds it. The edges of a
    strong component, up to `together` of them, go to SLICES tasks, each of
    which looks for the cycles of some of its nodes as roots and gives them one
    after the other: by blocking sets (Johnson 1975), or within max_length by
    the distance back to the root. So what is written are the cycles alone.
    Larger components grow paths by joins, a round for each length.
    """
    parts = strong_components(edges)
    a, b = parts.select(F.col("id").alias("src"), "component"), parts.select(F.col("id").alias("dst"), F.col("component").alias("other"))
    inside = materialize(edges.where("src <> dst").select("src", "dst").distinct().join(a, "src").join(b, "dst").where("component = other").select("src", "dst", "component"), "inside")
    sizes = inside.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    kind = edges.schema["src"].dataType.simpleString()
    small = inside.join(sizes.where(F.col("n") <= together), "component", "left_semi").groupBy("component").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("e"))
    dealt = small.select("component", F.col("e.src").alias("src"), F.col("e.dst").alias("dst"), F.explode(F.sequence(F.lit(0), F.least(F.size("e"), F.lit(SLICES)) - 1)).alias("slice")).repartition("component", "slice")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for src, dst, mine in zip(pdf["src"], pdf["dst"], pdf["slice"], strict=True):
                out: dict = {}
                for v, w in zip(src.tolist(), dst.tolist(), strict=True):
                    out.setdefault(v, []).append(w)
                found: list[list] = []
                for root in sorted(out)[mine :: min(len(src), SLICES)]:
                    for nodes in _circuits(out, root) if max_length is None else _short_circuits(out, root, max_length):
                        found.append(nodes)
                        if len(found) == 10_000:
                            yield pd.DataFrame({"nodes": found})
                            found = []
                if found:
                    yield pd.DataFrame({"nodes": found})

    found = dealt.mapInPandas(run, f"nodes array<{kind}>")
    large = inside.join(sizes.where(F.col("n") > together), "component", "left_semi").select("src", "dst")
    if not large.isEmpty():
        found = found.union(_grown_cycles(large, max_length))
    found = materialize(found, "cycles")
    return found.select("nodes", F.size("nodes").cast("long").alias("length"))


def canonical(nodes: Column) -> Column:
    """The rotation of a cycle that starts at its least node."""
    at = F.array_position(nodes, F.array_min(nodes)).cast("int")
    return F.concat(F.slice(nodes, at, F.size(nodes)), F.slice(nodes, F.lit(1), at - 1))


def severity(cycles: Column, share: Column) -> Column:
    """NONE, MINOR, MODERATE or SEVERE by the number of cycles and the percentage of nodes on them."""
    # fixed values: more than 20 cycles or 30 %, more than 5 or 10 %
    return F.when(cycles == 0, "NONE").when((cycles > 20) | (share > 30), "SEVERE").when((cycles > 5) | (share > 10), "MODERATE").otherwise("MINOR")


def cycle_report(nodes: DataFrame, cycles: DataFrame, components: DataFrame | None = None, max_length: int | None = None) -> DataFrame:
    """One row: number of cycles, nodes on them, their percentage, longest length, severity.

    With strong components (id, component), nodes are counted by those, so a
    bound on the length of cycles loses none; then truncated tells whether
    there may be cycles beyond max_length, and total_cycles, longest and
    severity are the least there can be.
    """
    on = cycles.select(F.explode("nodes").alias("id")) if components is None else components
    on = on.agg(F.count_distinct("id").alias("nodes_in_cycles"))
    all_ = cycles.agg(F.count(F.lit(1)).alias("total_cycles"), F.coalesce(F.max("length"), F.lit(0)).alias("longest"))
    share = F.round(F.coalesce(F.try_divide("nodes_in_cycles", "n") * 100, F.lit(0.0)), 6)
    out = all_.crossJoin(on).crossJoin(nodes.agg(F.count(F.lit(1)).alias("n"))).select("total_cycles", "longest", "nodes_in_cycles", share.alias("percent"))
    if components is None:
        return out.withColumn("severity", severity(F.col("total_cycles"), F.col("percent")))
    out = out.withColumn("severity", severity(F.greatest("total_cycles", (F.col("nodes_in_cycles") > 0).cast("long")), F.col("percent")))
    size = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    return out.crossJoin(size).withColumn("truncated", F.lit(False) if max_length is None else F.col("largest") > max_length).drop("largest")


def participants(cycles: DataFrame, n: int = 10) -> DataFrame:
    """The n nodes on most cycles, ties by id."""
    each = cycles.select(F.explode("nodes").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("cycles"))
    return each.orderBy(F.desc("cycles"), "id").limit(n)


def cycles_of(cycles: DataFrame, node: str, n: int = 10) -> DataFrame:
    """The n shortest cycles through a node, ties in order of their nodes."""
    return cycles.where(F.array_contains("nodes", node)).orderBy("length", "nodes").limit(n)


def nodes_in_cycles(edges: DataFrame, self_loops: bool = True) -> DataFrame:
    """Ids on any cycle; an edge to itself counts as one if self_loops is set."""
    found = strong_components(edges).select("id")
    return found.union(edges.where("src = dst").select(F.col("src").alias("id"))).distinct() if self_loops else found
