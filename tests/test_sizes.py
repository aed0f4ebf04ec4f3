"""What rows take in memory, not in files, and what a graph's depth and hubs may cost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topograph.functions.scratch import materialize
from topograph.llm import token_counts
from topograph.operators import callgraph, centrality, reach, resolve, whole_graph

DEPS = "'{}' AS language, 0 AS seq, '' AS raw_text, '{}' AS specifier, '{}_import' AS kind, 0 AS level, '' AS names, 1 AS line, 0 AS `column`, false AS is_wildcard"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def default_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(("language", "specifier"), [("kotlin", "lib.K7"), ("javascript", "../lib/K7")])
def test_candidates_are_not_broadcast(spark, default_broadcasts, language, specifier):
    """A table of imports is small as a file; its candidates, a dozen a row, are not."""
    deps = materialize(spark.range(2000).selectExpr("concat('app/p', id, '.x') AS path", *DEPS.format(language, specifier, language).split(", ")))
    index = spark.range(2_000_000).selectExpr("concat('lib/K', id, if(id = 7, if('{}' = 'kotlin', '.kt', '.js'), '.no')) AS path".format(language))
    found = resolve.resolve(deps, index)
    assert "BuildLeft" not in plan(found)
    assert found.where("target_path like 'lib/K7.%'").count() == 2000


def test_op6_broadcasts_no_documents(spark, default_broadcasts):
    """A document is a byte or two in a file of (file, ordinal, id), and some 250 in memory."""
    docs = spark.range(500).selectExpr("id AS doc_id", "repeat('a ', cast(id % 40 AS int)) AS text")
    counted = token_counts.document_token_counts(docs)
    assert "BroadcastHashJoin" not in plan(counted)
    assert counted.count() == counted.select("doc_id").distinct().count() == 500


def plain_distances(pairs, start):
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    far, level = {start: 0}, [start]
    for v in level:
        for w in out.get(v, ()):
            if w not in far:
                far[w] = far[v] + 1
                level.append(w)
    return far


@pytest.mark.parametrize("edges_of_a_task", [100_000, 75])
def test_deep_components_take_no_rounds(spark, monkeypatch, edges_of_a_task):
    """Chains of 71 nodes, in 64s and more, with jumps and ways back, beside shallow ones: not a table or more for each step."""
    pairs = [(1000 * k + i, 1000 * k + i + 1) for k in range(3) for i in range(70)] + [(i, i + 2) for i in range(0, 70, 5)] + [(i, i - 3) for i in range(7, 60, 7)]
    pairs += [(9000 + i, 9100 + i % 7) for i in range(50)] + [(5, 5)]
    nodes = sorted({x for p in pairs for x in p} | {77777})
    want = {v: plain_distances(pairs, v) for v in nodes}
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    seeds = spark.createDataFrame([(f"n{v}",) for v in nodes], "id string")
    monkeypatch.setattr(reach, "EDGES", edges_of_a_task)
    monkeypatch.setattr(reach, "CELLS", 64 * 80)
    tables = []
    monkeypatch.setattr(reach, "materialize", lambda df, name="step": tables.append(name) or materialize(df, name))
    found = reach.reach(edges, seeds)
    assert found.depth == max(max(x.values()) for x in want.values()) and (edges_of_a_task == 75 or len(tables) < 25)
    assert {r.id: r.reached for r in found.counts().collect()} == {f"n{v}": len(x) - 1 for v, x in want.items()}
    some = spark.createDataFrame([("n50",), ("n1069",)], "id string")
    assert {(r.origin, r.node) for r in found.pairs(some).collect()} == {(f"n{v}", f"n{w}") for v, x in want.items() for w in (50, 1069) if w in x and w != v}
    assert reach.reach(edges, seeds, 20, sets=False).depth == 20


def test_blocks_count_what_would_be_listed(spark):
    """At 40 billion calls of one name no row for each can be written; at a few thousand both ways agree, block by block."""
    calls = spark.range(300).selectExpr("concat('c', id % 90) AS path", "if(id % 2 = 0, 'java', 'kotlin') AS language", "0 AS seq", "concat('m', id) AS owner", "'' AS owner_class", "'x' AS receiver", "element_at(array('get', 'run', 'no', null), cast(id % 4 + 1 AS int)) AS name", "cast(500 - id AS int) AS line")
    symbols = spark.range(200).selectExpr("concat('s', id % 70) AS path", "if(id % 3 = 0, 'java', 'kotlin') AS language", "0 AS seq", "'method' AS symbol_type", "if(id % 5 = 0, 'run', 'get') AS name", "concat('method:X', id, '.f') AS fqn", "1 AS line")
    names = symbols.selectExpr("language", "path AS callee_path", "fqn AS callee_fqn", "name")
    for block in (7, 1024):
        listed = callgraph.named_calls(calls, symbols, block).join(names, ["callee_path", "callee_fqn"]).groupBy("language", "name").agg(F.count(F.lit(1)), F.min("site_line"), F.min("callee_path"))
        summed = callgraph.blocks(calls, symbols, block).groupBy("language", "name").agg(F.sum("edges"), F.min("first_line"), F.min("first_path"))
        assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, summed.collect())) != []
    many = calls.limit(1).selectExpr("path", "'java' AS language", "seq", "explode(sequence(1, 200000)) AS owner", "owner_class", "receiver", "'get' AS name", "line").withColumn("owner", F.col("owner").cast("string"))
    made = spark.range(200_000).selectExpr("'s' AS path", "'java' AS language", "0 AS seq", "'method' AS symbol_type", "'get' AS name", "cast(id AS string) AS fqn", "1 AS line")
    assert callgraph.blocks(many, made).selectExpr("sum(edges)", "count(*)").first()[:] == (200_000**2, 196**2)


def test_betweenness_with_the_whole_graph_in_tasks(spark, monkeypatch):
    """As by rows: with hubs, levels in pieces, repeated edges and nodes, loops, names of any kind; and without a table for each level."""
    pairs = [(i, 1000 + i % 9) for i in range(120)] + [(1000 + i, 2000 + j) for i in range(9) for j in range(30)] + [(2000 + j, i) for j in range(30) for i in range(j, 120, 30)] + [(3, 3), (0, 1000)]
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string").repartition(3)
    nodes = spark.createDataFrame([(f"n{v}",) for v in sorted({x for p in pairs for x in p})] + [("alone",)], "id string")
    rows = {r.id: r.betweenness for r in centrality.betweenness(nodes, edges, whole=0).collect()}
    assert len(rows) == 160 and max(rows.values()) > 0
    for steps in (1 << 21, 7):
        first = np.array([0, 2, 3, 4, 4])  # a diamond: 0 to 1 and 2, both to 3
        monkeypatch.setattr(whole_graph, "STEPS", steps)
        node, delta, _ = whole_graph.shares(first, np.array([1, 2, 3, 3], np.int32), 4, np.array([0]))
        assert dict(zip(node.tolist(), delta.tolist(), strict=True)) == {1: 0.5, 2: 0.5}
        out = {}
        for a, b in set(pairs):
            if a != b:
                out.setdefault(a, set()).add(b)
        names = sorted({x for p in pairs for x in p})
        at = {v: i for i, v in enumerate(names)}
        to = [at[w] for v in names for w in sorted(out.get(v, ()))]
        first = np.cumsum([0] + [len(out.get(v, ())) for v in names])
        node, delta, _ = whole_graph.shares(first, np.array(to, np.int32), len(names), np.arange(len(names)))
        total = np.bincount(node, delta, minlength=len(names)) / 159 / 158
        assert all(abs(total[at[v]] - rows[f"n{v}"]) < 1e-12 for v in names)
    tables = []
    for module in (centrality, whole_graph):
        monkeypatch.setattr(module, "materialize", lambda df, name="step": tables.append(name) or materialize(df, name))
    found = {r.id: r.betweenness for r in centrality.betweenness(nodes, edges).collect()}
    assert found.keys() == rows.keys() and all(abs(found[v] - rows[v]) < 1e-12 for v in rows) and len(tables) < 6


def test_estimates_share_one_graph(spark, monkeypatch):
    """A batch takes no table for each level, and gives what rows give, its errors too."""
    pairs = [(f"n{i}", f"h{i % 4}") for i in range(200)] + [(f"h{i}", f"m{j}") for i in range(4) for j in range(12)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = spark.createDataFrame([(v,) for v in sorted({x for p in pairs for x in p})], "id string")
    tables = []
    for module in (centrality, whole_graph):
        monkeypatch.setattr(module, "materialize", lambda df, name="step": tables.append(name) or materialize(df, name))
    graph = whole_graph.whole_graph(nodes, edges)
    tables.clear()
    found = {r.id: (r.betweenness, r.error) for r in centrality.estimated_betweenness(nodes, edges, error=0.9, batch=64, graph=graph).collect()}
    assert len(tables) <= 2 * 5
    rows = {r.id: (r.betweenness, r.error) for r in centrality.estimated_betweenness(nodes, edges, error=0.9, batch=64, whole=0).collect()}
    assert found.keys() == rows.keys() and all(abs(a - b) < 1e-12 for v in rows for a, b in zip(found[v], rows[v], strict=True))
