"""Shortest chains, the first in lexicographic order, against plain Python."""

import random

from topograph.operators import impact, traverse


def plain(edges, seeds):
    out = {}
    for s in seeds:
        level, seen = {s: [s]}, {s}
        while level:
            after = {}
            for node, path in level.items():
                for a, b in edges:
                    if a == node and b not in seen and (b not in after or [*path, b] < after[b]):
                        after[b] = [*path, b]
            seen |= set(after)
            out |= {(s, n): p for n, p in after.items()}
            level = after
    return out


def test_chains_are_the_first_of_the_shortest(spark):
    rng = random.Random(5)
    edges = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(75)} | {(f"k{i}", f"k{i + 1}") for i in range(11)} | {("n1", "k0")}
    seeds = ["n0", "n1", "n7", "none"]
    e = spark.createDataFrame([*edges, *list(edges)[:5]], "src string, dst string")
    s = spark.createDataFrame([(x,) for x in [*seeds, "n0"]], "id string")
    wanted = plain(edges, seeds)
    found = traverse.shortest_chains(e, s).collect()
    assert len(found) == len(wanted) > 30 and {(r.origin, r.node): r.path for r in found} == wanted and all(r.distance == len(r.path) - 1 for r in found)
    chains = impact.impact_chains(traverse.reversed_edges(e), s, 3).collect()
    kept = {k for o in seeds for k in sorted(k for k in wanted if k[0] == o)[:3]}
    assert {(r.mutated, r.affected): r.chain[::-1] for r in chains} == {k: wanted[k] for k in kept}


def test_chains_of_nothing(spark):
    e = spark.createDataFrame([], "src long, dst long")
    s = spark.createDataFrame([(1,)], "id long")
    assert traverse.shortest_chains(e, s).isEmpty() and traverse.shortest_chains(e, s.limit(0)).isEmpty()
    short = spark.createDataFrame([(1, 10), (1, 9), (10, 3), (9, 3), (3, 4)], "src long, dst long")
    assert sorted((r.node, r.path) for r in traverse.shortest_chains(short, s, 2).collect()) == [(3, [1, 9, 3]), (9, [1, 9]), (10, [1, 10])]
