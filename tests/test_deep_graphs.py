"""Components, cycles, reach and betweenness on random and deep graphs, against plain versions."""

import random

import pytest

from topograph.operators import centrality, cycles, impact, traverse
from topograph.operators.reach import reach

KIND = "src long, dst long"


def reached(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    found = {}
    for v in {x for p in pairs for x in p}:
        seen, stack = set(), [v]
        while stack:
            for w in out.get(stack.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    stack.append(w)
        found[v] = seen
    return found


def some_pairs(seed, n, m):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


RINGS = [(1000 + i, 1001 + i) for i in range(30)] + [(3, 1000), (1030, 3), (2000, 2001), (2001, 2000), (2001, 3000), (3000, 3001), (3001, 2001)] + [(4000 + i, 4000 + (i + 1) % 25) for i in range(25)] + [(5000 + i, 5001 + i) for i in range(25)]


@pytest.mark.parametrize("small", [0, cycles.SMALL])
@pytest.mark.parametrize("pairs", [some_pairs(1, 40, 60), some_pairs(2, 30, 25) + RINGS, [(i, i) for i in range(4)]])
def test_strong_components(spark, pairs, small):
    """Random graphs; chains that close over one node, over a component and not at all; rings; edges to oneself."""
    way = reached([p for p in pairs if p[0] != p[1]])
    want = {v: min(w for w in way[v] if v in way[w]) for v in way if v in way[v]}
    assert {r.id: r.component for r in cycles.strong_components(spark.createDataFrame(pairs, KIND), small).collect()} == want


def test_one_pass_of_random_graphs():
    for t in range(200):
        out: dict = {}
        for a, b in some_pairs(t, 3 + t % 20, 1 + t % 50):
            out.setdefault(a, []).append(b)
        way = reached([(a, b) for a in out for b in out[a]])
        want = {frozenset(w for w in way[v] if v in way[w]) for v in way if v in way[v]}
        assert {frozenset(c) for c in cycles._one_pass(out)} == {c for c in want if len(c) > 1}


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    from topograph.operators import components

    written = []
    plain = cycles.materialize
    counted = lambda *args: written.append(1) or plain(*args)
    monkeypatch.setattr(cycles, "materialize", counted)
    monkeypatch.setattr(components, "materialize", counted)
    ids = list(range(2000))
    random.Random(1).shuffle(ids)
    path = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), KIND)
    assert cycles.strong_components(path, 0).count() == 0 and len(written) < 40


def brute_cycles(pairs):
    out, found = {}, set()
    for a, b in pairs:
        if a != b:
            out.setdefault(a, set()).add(b)

    def go(root, path):
        for w in out.get(path[-1], ()):
            if w == root and len(path) > 1:
                found.add(tuple(path))
            elif w > root and w not in path:
                go(root, [*path, w])

    for v in out:
        go(v, [v])
    return found


def test_circuits_of_random_graphs():
    for t in range(300):
        pairs = some_pairs(t, 2 + t % 7, 1 + t % 23)
        want, out = brute_cycles(pairs), {}
        for a, b in sorted(set(pairs)):
            if a != b:
                out.setdefault(a, []).append(b)
        found = [tuple(c) for v in out for c in cycles._circuits(out, v)]
        assert len(found) == len(set(found)) and set(found) == want
        for longest in (2, 3, 5):
            found = [tuple(c) for v in out for c in cycles._short_circuits(out, v, longest)]
            assert len(found) == len(set(found)) and set(found) == {c for c in want if len(c) <= longest}


@pytest.mark.parametrize("together", [200_000, 3])
def test_simple_cycles(spark, together):
    """In tasks that hold a component, and by joins where components are larger; of strings too."""
    pairs = some_pairs(7, 12, 30) + [(50, 51), (51, 50)]
    edges = spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in pairs], "src string, dst string")
    want = {tuple(f"n{v:02}" for v in c) for c in brute_cycles(pairs)}
    found = cycles.simple_cycles(edges, together=together).collect()
    assert len(found) == len(want) > 5 and {tuple(r.nodes) for r in found} == want and all(len(r.nodes) == r.length for r in found)
    assert {tuple(r.nodes) for r in cycles.simple_cycles(edges, 3, together).collect()} == {c for c in want if len(c) <= 3}


def test_paths_that_cannot_close_are_not_kept(spark):
    """A dense graph without cycles beside one ring: growing paths would keep 2^18 of them."""
    pairs = [(i, j) for i in range(20) for j in range(i + 1, 20)] + [(100, 101), (101, 102), (102, 100), (19, 100)]
    assert [tuple(r.nodes) for r in cycles.simple_cycles(spark.createDataFrame(pairs, KIND)).collect()] == [(100, 101, 102)]
    dense = {i: [*range(i + 1, 20)] for i in range(20)} | {18: [19, 0]}
    assert sum(1 for _ in cycles._circuits(dense | {18: [0]}, 0)) == 1 << 17


def test_reach(spark):
    """More seeds than one number has bits, over some partitions."""
    pairs = some_pairs(3, 150, 190)
    way = reached(pairs)
    edges = spark.createDataFrame(pairs, KIND).repartition(3)
    seeds = spark.createDataFrame([(v,) for v in way], "id long").repartition(3)
    found = reach(edges, seeds)
    assert {r.id: r.reached for r in found.counts().collect()} == {v: len(w - {v}) for v, w in way.items()}
    some = spark.createDataFrame([(v,) for v in range(0, 150, 9)], "id long")
    assert {(r.origin, r.node) for r in found.pairs(some).collect()} == {(v, w) for v in way for w in way[v] if w % 9 == 0 and w != v}
    assert reach(edges, seeds, 1).depth == 1
    empty = reach(edges.limit(0), seeds)
    assert empty.depth == 0 and {r.reached for r in empty.counts().collect()} == {0}
    per = {r.mutated: (r.directly_affected, r.total_affected) for r in impact.impact_per_node(seeds, edges, seeds).collect()}
    up = reached([(b, a) for a, b in pairs])
    assert per == {v: (len({a for a, b in pairs if b == v and a != v}), len(up[v] - {v})) for v in way}
    assert traverse.max_call_depth(edges.limit(0)).first().max_depth == 0


def test_estimated_betweenness(spark):
    """Within its error of the exact values for every node, after some of the sources; exact with all."""
    hubs = [(i, 1000 + i % 3) for i in range(400)] + [(1000 + i, 2000 + j) for i in range(3) for j in range(40)] + [(2000 + j, i) for j in range(40) for i in range(j, 400, 40)]
    edges = spark.createDataFrame(hubs, KIND)
    nodes = spark.createDataFrame([(v,) for v in {x for p in hubs for x in p}], "id long")
    exact = {r.id: r.betweenness for r in centrality.betweenness(nodes, edges).collect()}
    rough = centrality.estimated_betweenness(nodes, edges, error=0.45, batch=64).collect()
    assert all(abs(r.betweenness - exact[r.id]) <= r.error <= 0.45 for r in rough) and min(r.error for r in rough) > 0
    whole = centrality.estimated_betweenness(nodes, edges, error=0, batch=200).collect()
    assert all(abs(r.betweenness - exact[r.id]) < 1e-12 and r.error == 0 for r in whole)
    assert centrality.estimated_betweenness(nodes.limit(2), edges).count() == 2
