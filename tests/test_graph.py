import random

from topograph.operators import centrality, cycles, graph, impact, traverse
from topograph.operators.components import connected_components


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_cycles_of_literal_graphs(spark):
    assert cycles.simple_cycles(edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])).count() == 0
    two = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("a", "d"), ("q", "q")])
    found = {tuple(r.nodes) for r in cycles.simple_cycles(two).collect()}
    assert found == {("a", "b", "c"), ("x", "y", "z")}
    assert {r.id for r in cycles.nodes_in_cycles(two).collect()} == {"a", "b", "c", "x", "y", "z", "q"}


def test_severity(spark):
    rows = spark.createDataFrame([(0, 0.0), (2, 2.0), (8, 5.0), (25, 40.0)], "c long, p double")
    from pyspark.sql import functions as F

    assert [r.s for r in rows.select(cycles.severity(F.col("c"), F.col("p")).alias("s")).collect()] == ["NONE", "MINOR", "MODERATE", "SEVERE"]


def test_service_chain(spark):
    e = edges(spark, [("web", "service"), ("service", "db")])
    n = ids(spark, ["web", "service", "db"])
    row = impact.impact_per_node(n, e, ids(spark, ["db"])).first()
    assert (row.directly_affected, row.total_affected, round(row.blast_component), round(row.blast_project)) == (1, 2, 100, 100)
    chains = {tuple(r.chain) for r in impact.impact_chains(e, ids(spark, ["db"])).collect()}
    assert chains == {("web", "service", "db"), ("service", "db")}


def test_against_plain_python_on_random_graphs(spark):
    rng = random.Random(5)
    for _ in range(2):
        names = list("abcdefgh")
        pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(14)})
        out = {n: {b for a, b in pairs if a == n and b != n} for n in names}

        def bfs(s, out=out):
            d, todo = {s: 0}, [s]
            for x in todo:
                for y in out[x]:
                    if y not in d:
                        d[y] = d[x] + 1
                        todo.append(y)
            return d

        dist = {n: bfs(n) for n in names}
        got = {(r.origin, r.node): r.distance for r in traverse.distances(edges(spark, pairs), ids(spark, names)).collect()}
        assert got == {(s, v): d for s in names for v, d in dist[s].items() if d}
        scc = {n: min(m for m in names if m in dist[n] and n in dist[m]) for n in names}
        scc = {n: c for n, c in scc.items() if sum(c == x for x in scc.values()) > 1}
        assert {r.id: r.component for r in cycles.strong_components(edges(spark, pairs)).collect()} == scc

        sigma = {s: {s: 1} for s in names}
        for s in names:
            for v in sorted(dist[s], key=dist[s].get):
                if v != s:
                    sigma[s][v] = sum(sigma[s][u] for u in dist[s] if v in out[u] and dist[s][u] + 1 == dist[s][v])
        want = {v: sum(sigma[s][v] * sigma[v][t] / sigma[s][t] for s in names for t in names if s != v != t != s and v in dist[s] and t in dist[v] and dist[s][t] == dist[s][v] + dist[v][t]) / 42 for v in names}
        got = {r.id: r.betweenness for r in centrality.betweenness(ids(spark, names), edges(spark, pairs)).collect()}
        assert all(abs(got[v] - want[v]) < 1e-9 for v in names)


def test_components_of_a_long_path(spark):
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y")]
    found = {r.id: r.component for r in connected_components(edges(spark, pairs)).collect()}
    assert found == {f"n{i:03}": "n000" for i in range(61)} | {"x": "x", "y": "x"}


def test_high_risk_takes_the_upper_fifth(spark):
    deg = spark.createDataFrame([(f"f{i}", i, 0) for i in range(10)], "id string, in_degree long, out_degree long")
    assert {r.id for r in graph.high_risk(deg).collect()} == {"f8", "f9"}
