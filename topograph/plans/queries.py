"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topograph.functions import scalar as S
from topograph.operators import centrality, cycles, graph, history, impact, risk, selection, snapshots, traverse
from topograph.plans import derived as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# Shared table expressions of the SQL side.
_SALES = """sales AS (
  SELECT cn.n_name AS src, sn.n_name AS dst, CAST(l_shipdate AS DATE) AS day, CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT) AS units
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey WHERE cn.n_name <> sn.n_name)"""


def _ranked(name: str, where: str = "true", keep: int = 3) -> str:
    return f"""{name} AS (SELECT src, dst, seq FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY sum(units) DESC, dst) AS seq
  FROM sales WHERE {where} GROUP BY src, dst) WHERE seq <= {keep})"""


_EDGES = f"{_SALES}, {_ranked('e')}"
_NODES = "n AS (SELECT n_name AS id FROM nation)"
_TESTS = "t AS (SELECT n_name AS id FROM nation WHERE n_regionkey = 0)"
_DEGREE = """deg AS (SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS in_degree, (SELECT count(*) FROM e WHERE src = id) AS out_degree FROM n)"""
CHANGED = ["NATION_5", "NATION_6", "NATION_7", "NATION_17", "NATION_19"]
_CHANGED = "c AS (SELECT id FROM n WHERE id IN ('NATION_5', 'NATION_6', 'NATION_7', 'NATION_17', 'NATION_19'))"
# reverse reachability with hop counts from the changed nodes, or from all nodes
_BACK = """walk(origin, node, d) AS (SELECT id, id, 0 FROM c UNION SELECT origin, e.src, d + 1 FROM walk JOIN e ON e.dst = node WHERE d < 25),
back AS (SELECT origin AS mutated, node AS affected, min(d) AS distance FROM walk GROUP BY 1, 2 HAVING min(d) > 0)"""
_REACH = """walk(s, v, d) AS (SELECT id, id, 0 FROM n UNION SELECT s, e.dst, d + 1 FROM walk JOIN e ON e.src = v WHERE d < 25),
dist AS (SELECT s, v, min(d) AS d FROM walk GROUP BY 1, 2)"""
_CYCLES = """p(root, last, nodes) AS (SELECT src, dst, [src, dst] FROM e WHERE dst > src
  UNION ALL SELECT root, e.dst, list_append(nodes, e.dst) FROM p JOIN e ON e.src = last WHERE e.dst > root AND NOT list_contains(nodes, e.dst)),
cyc AS (SELECT nodes, CAST(len(nodes) AS BIGINT) AS length FROM p JOIN e ON e.src = last AND e.dst = root)"""
_SIGMA = """sig(s, v, d) AS (SELECT id, id, 0 FROM n UNION ALL SELECT sig.s, e.dst, sig.d + 1 FROM sig JOIN e ON e.src = sig.v JOIN dist ON dist.s = sig.s AND dist.v = e.dst AND dist.d = sig.d + 1),
paths AS (SELECT s, v, count(*) AS k FROM sig GROUP BY 1, 2),
bt AS (SELECT n.id, coalesce((SELECT sum(CAST(a.k * b.k AS DOUBLE) / c.k) FROM dist x JOIN dist y ON y.s = x.v JOIN dist z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d
  JOIN paths a ON a.s = x.s AND a.v = x.v JOIN paths b ON b.s = y.s AND b.v = y.v JOIN paths c ON c.s = z.s AND c.v = z.v
  WHERE x.v = n.id AND x.s <> n.id AND y.v <> n.id AND x.s <> y.v), 0) / ((SELECT count(*) FROM n) - 1) / ((SELECT count(*) FROM n) - 2) AS betweenness FROM n)"""
_SEVERITY = "CASE WHEN {c} = 0 THEN 'NONE' WHEN {c} > 20 OR {p} > 30 THEN 'SEVERE' WHEN {c} > 5 OR {p} > 10 THEN 'MODERATE' ELSE 'MINOR' END"


def sql(name: str, *parts: str, select: str) -> None:
    ORACLE_SQL[name] = f"WITH RECURSIVE {', '.join(parts)} {select}"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.trade_nodes(spark, sf_dir).where(F.col("id").isin(CHANGED))


def r6(c: str) -> F.Column:
    return F.round(F.col(c).cast("double"), 6).alias(c)


def long(c: str) -> F.Column:
    return F.col(c).cast("long").alias(c)


# Graph


@query
def edge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sales are repeated imports; the last day's one stays."""
    sold = D.sales(spark, sf_dir).withColumn("seq", F.struct("day", "units"))
    return graph.dedupe_edges(sold.select("src", "dst", "seq")).select("src", "dst", F.col("seq.day").cast("string").alias("day"), F.col("seq.units").alias("units"))


sql("edge_dedupe", _SALES, select="SELECT src, dst, CAST(max(day) AS VARCHAR) AS day, CAST(arg_max(units, (day, units)) AS BIGINT) AS units FROM sales GROUP BY src, dst")


@query
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(D.trade_nodes(spark, sf_dir), D.trade_edges(spark, sf_dir))


sql("degree", _EDGES, _NODES, _DEGREE, select="SELECT * FROM deg")


@query
def supply_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of the larger bipartite graph of parts and suppliers."""
    pairs = D.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    nodes = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct()
    return graph.degrees(nodes, pairs)


sql("supply_degree", "e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem)", select="SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id")


@query
def top_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top(degree(spark, sf_dir), "in_degree")


sql("top_in", _EDGES, _NODES, _DEGREE, select="SELECT id, in_degree FROM deg WHERE in_degree > 0 ORDER BY in_degree DESC, id LIMIT 10")


@query
def top_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top(degree(spark, sf_dir), "out_degree")


sql("top_out", _EDGES, _NODES, _DEGREE, select="SELECT id, out_degree FROM deg WHERE out_degree > 0 ORDER BY out_degree DESC, id LIMIT 10")


@query
def high_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.high_risk(degree(spark, sf_dir))


sql("high_risk", _EDGES, _NODES, _DEGREE, select="SELECT id, in_degree FROM deg WHERE in_degree >= (SELECT in_degree FROM (SELECT in_degree, row_number() OVER (ORDER BY in_degree, id) AS k FROM deg) WHERE k = (SELECT count(*) - greatest(1, count(*) // 5) FROM n) + 1)")


@query
def ghost_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of region 4 weren't scanned: which of them are imported by others."""
    known = D.table(spark, sf_dir, "nation").where("n_regionkey <> 4").select(F.col("n_name").alias("id"))
    edges = D.trade_edges(spark, sf_dir).join(known.withColumnRenamed("id", "src"), "src", "left_semi")
    return graph.ghosts(known, edges)


sql("ghost_nodes", _EDGES, "k AS (SELECT n_name AS id FROM nation WHERE n_regionkey <> 4)", select="SELECT DISTINCT dst AS id FROM e WHERE src IN (SELECT id FROM k) AND dst NOT IN (SELECT id FROM k)")


@query
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, edges and links of pages as dependencies."""
    deps = resolve_classify(spark, sf_dir)
    pages = D.table(spark, sf_dir, "pages").select(F.lit(False).alias("is_ghost"), F.lit(1).alias("symbol_count"), F.lit(None).cast("string").alias("error"))
    out = graph.graph_stats(pages, deps.where("target is not null").select("path", "target").distinct(), deps, pages)
    return out.select(*(long(c) for c in out.columns))


_IMPORTS = """imp AS (SELECT page_id AS path, unnest(range(len(h))) AS seq, unnest(h) AS specifier FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)),
idx AS (SELECT regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS p, min(page_id) AS target FROM pages GROUP BY 1),
dep AS (SELECT path, seq, specifier, target, NOT starts_with(specifier, '/') AS is_external, starts_with(specifier, '/') AND target IS NULL AS is_unresolved FROM imp LEFT JOIN idx ON specifier = p)"""
sql("graph_stats", _IMPORTS, select="SELECT (SELECT count(*) FROM pages) AS total_files, (SELECT count(*) FROM pages) AS total_symbols, CAST(0 AS BIGINT) AS ghost_files, (SELECT count(*) FROM (SELECT DISTINCT path, target FROM dep WHERE target IS NOT NULL)) AS total_edges, (SELECT count(*) FROM dep WHERE NOT is_external) AS internal_dependencies, (SELECT count(*) FROM dep WHERE is_external) AS external_dependencies, (SELECT count(*) FROM dep WHERE is_unresolved) AS unresolved_dependencies, (SELECT count(*) FROM pages) AS scanned_files, CAST(0 AS BIGINT) AS failed_files")


@query
def language_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.language_breakdown(D.files(spark, sf_dir))


sql("language_breakdown", "x AS (SELECT 1)", select="SELECT lang AS language, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS size_bytes FROM documents GROUP BY lang")


# Reachability and impact


@query
def impact_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blast radius of each changed nation alone, by both denominators."""
    out = impact.impact_per_node(D.trade_nodes(spark, sf_dir), D.trade_edges(spark, sf_dir), changed(spark, sf_dir))
    return out.select("mutated", "directly_affected", "total_affected", r6("blast_component"), r6("blast_project"))


_WCC = """both_ AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), ww(s, v) AS (SELECT id, id FROM n UNION SELECT s, b.dst FROM ww JOIN both_ b ON b.src = v),
wcc AS (SELECT s AS id, min(v) AS component, count(*) AS size FROM ww GROUP BY s)"""
sql("impact_single", _EDGES, _NODES, _CHANGED, _BACK, _WCC, select="""SELECT id AS mutated, (SELECT count(*) FROM back WHERE mutated = id AND distance = 1) AS directly_affected, (SELECT count(*) FROM back WHERE mutated = id) AS total_affected,
  round(((SELECT count(*) FROM back WHERE mutated = id) + 1) / (SELECT size FROM wcc WHERE wcc.id = c.id) * 100, 6) AS blast_component, round(((SELECT count(*) FROM back WHERE mutated = id) + 1) / (SELECT count(*) FROM n) * 100, 6) AS blast_project FROM c""")


@query
def impact_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = impact.impact_together(D.trade_nodes(spark, sf_dir), D.trade_edges(spark, sf_dir), changed(spark, sf_dir))
    return out.select("mutated", "affected", r6("blast_radius"), S.blast_level(F.col("blast_radius")).alias("level"))


_BLAST = "bl AS (SELECT round(count(*) / (SELECT count(*) FROM n) * 100, 6) AS blast_radius FROM (SELECT affected AS id FROM back UNION SELECT id FROM c))"
sql("impact_multi", _EDGES, _NODES, _CHANGED, _BACK, _BLAST, select="SELECT (SELECT count(*) FROM c) AS mutated, (SELECT count(DISTINCT affected) FROM back) AS affected, blast_radius, CASE WHEN blast_radius >= 50 THEN 'HIGH' WHEN blast_radius >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM bl")


@query
def impact_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.impact(D.trade_edges(spark, sf_dir), changed(spark, sf_dir)).where("is_direct").select("mutated", "affected")


sql("impact_direct", _EDGES, _NODES, _CHANGED, select="SELECT DISTINCT e.dst AS mutated, e.src AS affected FROM e JOIN c ON e.dst = c.id")


@query
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the graph that each nation's change reaches."""
    nodes = D.trade_nodes(spark, sf_dir)
    out = impact.impact_per_node(nodes, D.trade_edges(spark, sf_dir), nodes)
    return out.select(F.col("mutated").alias("id"), r6("blast_project"), S.blast_level(F.col("blast_project")).alias("level"))


sql("blast_radius", _EDGES, _NODES, _REACH, "b AS (SELECT v AS id, round(count(*) / (SELECT count(*) FROM n) * 100, 6) AS p FROM dist GROUP BY v)", select="SELECT id, p AS blast_project, CASE WHEN p >= 50 THEN 'HIGH' WHEN p >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM b")


@query
def wcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.component_sizes(D.trade_nodes(spark, sf_dir), D.trade_edges(spark, sf_dir))


sql("wcc", _EDGES, _NODES, _WCC, select="SELECT id, component, size FROM wcc")


@query
def bfs_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = traverse.distances(D.trade_edges(spark, sf_dir), changed(spark, sf_dir))
    return found.select("origin", "node", long("distance"))


sql("bfs_distance", _EDGES, _NODES, _CHANGED, "walk(s, v, d) AS (SELECT id, id, 0 FROM c UNION SELECT s, e.dst, d + 1 FROM walk JOIN e ON e.src = v WHERE d < 25)", select="SELECT s AS origin, v AS node, CAST(min(d) AS BIGINT) AS distance FROM walk GROUP BY 1, 2 HAVING min(d) > 0")


@query
def impact_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the shortest chains to a changed nation the first, read from its end, in order of names."""
    out = impact.impact_chains(D.trade_edges(spark, sf_dir), changed(spark, sf_dir))
    return out.select("mutated", "affected", long("length"), F.array_join("chain", ">").alias("chain"))


sql("impact_chain", _EDGES, _NODES, _CHANGED, "w(origin, node, path) AS (SELECT id, id, [id] FROM c UNION ALL SELECT origin, e.src, list_append(path, e.src) FROM w JOIN e ON e.dst = node WHERE len(path) < 7 AND NOT list_contains(path, e.src))", "b AS (SELECT origin, node, path, row_number() OVER (PARTITION BY origin, node ORDER BY len(path), path) AS k FROM w WHERE len(path) > 1)", select="SELECT origin AS mutated, node AS affected, CAST(len(path) - 1 AS BIGINT) AS length, array_to_string(list_reverse(path), '>') AS chain FROM b WHERE k = 1")


@query
def khop_ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.ego(D.trade_edges(spark, sf_dir), changed(spark, sf_dir).where("id = 'NATION_6'"), 1)


sql("khop_ego", _EDGES, "near AS (SELECT 'NATION_6' AS id UNION SELECT src FROM e WHERE dst = 'NATION_6' UNION SELECT dst FROM e WHERE src = 'NATION_6')", select="SELECT src, dst FROM e WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)")


@query
def callers_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = traverse.callers(D.trade_edges(spark, sf_dir), changed(spark, sf_dir), 2)
    return out.select("caller", long("distance"))


sql("callers_transitive", _EDGES, _NODES, _CHANGED, _BACK, select="SELECT affected AS caller, CAST(min(distance) AS BIGINT) AS distance FROM back WHERE distance <= 2 GROUP BY affected")


@query
def max_call_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.max_call_depth(D.trade_edges(spark, sf_dir))


sql("max_call_depth", _EDGES, _NODES, _REACH, select="SELECT CAST(max(d) + 1 AS BIGINT) AS max_depth FROM dist")


# Cycles and centrality


def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.simple_cycles(D.trade_edges(spark, sf_dir))


def _joined(found: DataFrame) -> DataFrame:
    return found.select(F.array_join("nodes", ">").alias("cycle"), "length")


@query
def simple_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(_cycles(spark, sf_dir))


sql("simple_cycles", _EDGES, _CYCLES, select="SELECT array_to_string(nodes, '>') AS cycle, length FROM cyc")


@query
def cycle_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.participants(_cycles(spark, sf_dir))


sql("cycle_participants", _EDGES, _CYCLES, select="SELECT id, count(*) AS cycles FROM (SELECT unnest(nodes) AS id FROM cyc) GROUP BY id ORDER BY 2 DESC, 1 LIMIT 10")


@query
def cycle_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cycles.cycle_report(D.trade_nodes(spark, sf_dir), _cycles(spark, sf_dir))
    return out.select("total_cycles", "longest", "nodes_in_cycles", r6("percent"), "severity")


sql("cycle_report", _EDGES, _NODES, _CYCLES, "x AS (SELECT count(*) AS c, coalesce(max(length), 0) AS longest, (SELECT count(DISTINCT id) FROM (SELECT unnest(nodes) AS id FROM cyc)) AS k FROM cyc)", "y AS (SELECT *, round(k / (SELECT count(*) FROM n) * 100, 6) AS p FROM x)", select=f"SELECT c AS total_cycles, longest, k AS nodes_in_cycles, p AS percent, {_SEVERITY.format(c='c', p='p')} AS severity FROM y")


@query
def cycles_for_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(cycles.cycles_of(_cycles(spark, sf_dir), "NATION_6"))


sql("cycles_for_node", _EDGES, _CYCLES, select="SELECT array_to_string(nodes, '>') AS cycle, length FROM cyc WHERE list_contains(nodes, 'NATION_6') ORDER BY length, nodes LIMIT 10")


@query
def scc_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.strong_components(D.trade_edges(spark, sf_dir))


sql("scc_nodes", _EDGES, _NODES, _REACH, select="SELECT a.s AS id, least(min(a.v), a.s) AS component FROM dist a JOIN dist b ON b.s = a.v AND b.v = a.s WHERE a.s <> a.v GROUP BY a.s")


@query
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centrality.betweenness(D.trade_nodes(spark, sf_dir), D.trade_edges(spark, sf_dir))
    return out.select("id", r6("betweenness"))


sql("betweenness", _EDGES, _NODES, _REACH, _SIGMA, select="SELECT id, round(betweenness, 6) AS betweenness FROM bt")


# Risk


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, some = D.trade_nodes(spark, sf_dir), D.trade_edges(spark, sf_dir), changed(spark, sf_dir)
    blast = impact.impact_together(nodes, edges, some)
    return risk.risk_components(some, some, nodes, graph.degrees(nodes, edges), centrality.betweenness(nodes, edges), blast, cycles=cycles.simple_cycles(edges))


@query
def risk_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risk(spark, sf_dir).select("name", r6("weight"), r6("raw_value"), r6("normalized_value"), r6("contribution"))


_RISK = """k AS (SELECT max(in_degree) AS mx, avg(out_degree / (in_degree + out_degree)) FILTER (in_degree + out_degree > 0) AS fan FROM deg JOIN c USING (id)),
cc AS (SELECT count(DISTINCT nodes) AS cycles, count(DISTINCT id) AS k FROM (SELECT nodes, unnest(nodes) AS id FROM cyc) WHERE id IN (SELECT id FROM c)),
m AS (SELECT (SELECT count(*) FROM n) AS n, (SELECT count(*) FROM c) AS f, mx, fan, (SELECT avg(betweenness) FROM bt JOIN c USING (id)) AS b, blast_radius, cycles, cc.k AS on_ FROM k, bl, cc),
comp(name, weight, raw_value, normalized_value) AS (
  SELECT 'impact_radius.blast', 0.18, blast_radius, least(blast_radius / 100, 1) FROM m UNION ALL SELECT 'impact_radius.in_degree', 0.12, mx, mx / n FROM m
  UNION ALL SELECT 'change_nature.file_count', 0.0375, f, least(f / 20, 1) FROM m UNION ALL SELECT 'change_nature.line_count', 0.0625, 0, 0 FROM m
  UNION ALL SELECT 'change_nature.api_change', 0.0875, 0, 0 FROM m UNION ALL SELECT 'change_nature.core_path', 0.0625, 0, 0 FROM m
  UNION ALL SELECT 'historical_hotspot', 0.25, 0, 0 FROM m UNION ALL SELECT 'coupling_risk.betweenness', 0.08, b, b FROM m
  UNION ALL SELECT 'coupling_risk.cycle_participation', 0.06, cycles, least(cycles / 10 * 0.5 + on_ / n * 0.5, 1) FROM m UNION ALL SELECT 'coupling_risk.fan_ratio', 0.06, fan, fan FROM m)"""
_RISK_PARTS = (_EDGES, _NODES, _CHANGED, _BACK, _BLAST, _DEGREE, _CYCLES, _REACH.replace("walk", "walk2"), _SIGMA, _RISK)
sql("risk_components", *_RISK_PARTS, select="SELECT name, round(CAST(weight AS DOUBLE), 6) AS weight, round(CAST(raw_value AS DOUBLE), 6) AS raw_value, round(CAST(normalized_value AS DOUBLE), 6) AS normalized_value, round(CAST(normalized_value * CAST(weight AS DOUBLE) AS DOUBLE), 6) AS contribution FROM comp")


@query
def risk_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = risk.risk_total(_risk(spark, sf_dir))
    return out.select(r6("score"), r6("score_100"), "level", "level_raw")


sql("risk_total", *_RISK_PARTS, "s AS (SELECT sum(normalized_value * CAST(weight AS DOUBLE)) AS score FROM comp)", select="SELECT round(score, 6) AS score, round(score * 100, 6) AS score_100, CASE WHEN score * 100 >= 70 THEN 'HIGH' WHEN score * 100 >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS level, 'LOW' AS level_raw FROM s")


# History


@query
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = history.hotspots(D.commits(spark, sf_dir), D.commit_files(spark, sf_dir))
    return out.select("path", "total_commits", "bug_fix_commits", "churn_count", r6("bug_fix_rate"), r6("churn_frequency"), "is_hotspot")


_HOT = """cf AS (SELECT DISTINCT l_orderkey AS commit, l_partkey AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
pf AS (SELECT path, count(*) AS total_commits, count(*) FILTER (o_orderpriority = '1-URGENT') AS bug_fix_commits FROM cf JOIN orders ON commit = o_orderkey GROUP BY path),
al AS (SELECT sum(bug_fix_commits) / greatest(sum(total_commits), 1) AS rate, sum(total_commits) / greatest(count(*), 1) AS mean FROM pf),
hot AS (SELECT path, total_commits, bug_fix_commits, bug_fix_commits / greatest(total_commits, 1) AS r, least(total_commits / greatest(mean, 1), 3) AS churn, bug_fix_commits / greatest(total_commits, 1) > 2 * rate AS is_hotspot FROM pf, al)"""
_PAIRS = """fit AS (SELECT l_orderkey AS commit FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) BETWEEN 2 AND 20),
fp AS (SELECT DISTINCT l_orderkey AS commit, l_partkey AS path FROM lineitem WHERE l_orderkey IN (SELECT commit FROM fit)),
co AS (SELECT DISTINCT a.path, b.path AS other FROM fp a JOIN fp b ON a.commit = b.commit AND a.path <> b.path)"""
sql("hotspots", _HOT, select="SELECT path, total_commits, bug_fix_commits, total_commits AS churn_count, round(r, 6) AS bug_fix_rate, round(churn, 6) AS churn_frequency, is_hotspot FROM hot")


@query
def co_change_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part the number of parts that it was ordered with, and their least and greatest key."""
    pairs = history.co_changes(D.commit_files(spark, sf_dir))
    return pairs.groupBy("path").agg(F.count(F.lit(1)).alias("others"), F.min("other").alias("least"), F.max("other").alias("greatest"))


sql("co_change_pairs", _PAIRS, select="SELECT path, count(*) AS others, min(other) AS least, max(other) AS greatest FROM co GROUP BY path")


@query
def co_change_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.hotspots(D.commits(spark, sf_dir), D.commit_files(spark, sf_dir)).select("path", "co_change_count")


sql("co_change_count", _HOT, _PAIRS, select="SELECT path, coalesce(k, 0) AS co_change_count FROM hot LEFT JOIN (SELECT co.path, count(*) AS k FROM co JOIN hot h ON h.path = co.other AND h.is_hotspot GROUP BY co.path) USING (path)")


@query
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits and fixes of the last 90 days before the latest order, by day."""
    recent = history.since(D.commits(spark, sf_dir))
    return recent.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("commits"), F.count_if("is_fix").alias("fixes"))


sql("history_window", "x AS (SELECT max(o_orderdate) AS latest FROM orders)", select="SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS commits, count(*) FILTER (o_orderpriority = '1-URGENT') AS fixes FROM orders, x WHERE o_orderdate >= latest - INTERVAL 90 DAYS GROUP BY 1")


@query
def bug_fix_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as messages of commits."""
    turns = D.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", S.is_bug_fix(F.col("text")).alias("is_fix"))


sql("bug_fix_flag", "x AS (SELECT 1)", select=f"SELECT conv_id, turn, coalesce(regexp_matches(lower(text), '{S.bug_pattern()}'), false) AS is_fix FROM conversations")


# Snapshots: trade before two dates


_BEFORE = ("1997-07-01", "2000-01-01")


def _snapshot_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The older snapshot keeps two edges for each node, the newer three."""
    from topograph.functions.scratch import materialize

    sold = D.sales(spark, sf_dir)
    one, two = (D.ranked_edges(sold.where(F.col("day") < F.lit(day).cast("date")), keep) for day, keep in zip(_BEFORE, (2, 3), strict=True))
    return materialize(one, "older"), materialize(two, "newer")


_SNAP = f"{_SALES}, {_ranked('o', f'''day < DATE '{_BEFORE[0]}' ''', 2)}, {_ranked('w', f'''day < DATE '{_BEFORE[1]}' ''', 3)}"
_SNAP_DEG = "od AS (SELECT id AS path, (SELECT count(*) FROM o WHERE dst = id) AS d FROM n), wd AS (SELECT id AS path, (SELECT count(*) FROM w WHERE dst = id) AS d FROM n)"


def _snap_cycles(edges: str, p: str, c: str) -> str:
    return _CYCLES.replace("FROM e ", f"FROM {edges} ").replace("JOIN e ", f"JOIN {edges} ").replace("e.", f"{edges}.").replace("p(root", f"{p}(root").replace("FROM p ", f"FROM {p} ").replace("cyc AS", f"{c} AS")


_NEW_CYCLES = ", ".join([_snap_cycles("o", "po", "oc"), _snap_cycles("w", "pw", "wc"), "nc AS (SELECT nodes, length FROM wc WHERE nodes NOT IN (SELECT nodes FROM oc))"])


def _snapshot_metrics(spark: SparkSession, sf_dir: str, one: DataFrame, two: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = D.trade_nodes(spark, sf_dir)
    return snapshots.metrics("older", graph.degrees(nodes, one)), snapshots.metrics("newer", graph.degrees(nodes, two))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    one, two = _snapshot_edges(spark, sf_dir)
    return *_snapshot_metrics(spark, sf_dir, one, two), one, two, cycles.simple_cycles(one), cycles.simple_cycles(two)


@query
def snapshot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshot_metrics(spark, sf_dir, *_snapshot_edges(spark, sf_dir))
    return old.unionByName(new).select("tag", "path", "in_degree", "out_degree")


sql("snapshot_metrics", _SNAP, _NODES, select="SELECT 'older' AS tag, id AS path, (SELECT count(*) FROM o WHERE dst = id) AS in_degree, (SELECT count(*) FROM o WHERE src = id) AS out_degree FROM n UNION ALL SELECT 'newer', id, (SELECT count(*) FROM w WHERE dst = id), (SELECT count(*) FROM w WHERE src = id) FROM n")


@query
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.diff(*_both(spark, sf_dir))


sql("snapshot_diff", _SNAP, _NODES, _NEW_CYCLES, select="SELECT CAST(0 AS BIGINT) AS files_added, CAST(0 AS BIGINT) AS files_removed, count(*) AS older_files, count(*) AS newer_files, (SELECT count(*) FROM o) AS older_edges, (SELECT count(*) FROM w) AS newer_edges, (SELECT count(*) FROM nc) AS new_cycles, round(((SELECT count(*) FROM w) - (SELECT count(*) FROM o)) / greatest((SELECT count(*) FROM o), 1) * 100, 6) AS edge_growth_pct FROM n")


@query
def snapshot_new_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = map(cycles.simple_cycles, _snapshot_edges(spark, sf_dir))
    return snapshots.new_cycles(one, two).select(F.array_join("nodes", ">").alias("cycle"))


sql("snapshot_new_cycles", _SNAP, _NEW_CYCLES, select="SELECT array_to_string(nodes, '>') AS cycle FROM nc")


@query
def trend_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.trend_alerts(*_both(spark, sf_dir))


sql("trend_alerts", _SNAP, _NODES, _NEW_CYCLES, _SNAP_DEG, "g AS (SELECT round(((SELECT count(*) FROM w) - (SELECT count(*) FROM o)) / (SELECT count(*) FROM o) * 100, 6) AS v)", select="SELECT 'edge_growth' AS kind, 'WARNING' AS severity, 'edges' AS subject, v AS value FROM g WHERE v > 30 UNION ALL SELECT 'new_cycles', 'CRITICAL', 'cycles', CAST(count(*) AS DOUBLE) FROM nc HAVING count(*) > 0 UNION ALL SELECT 'in_degree_growth', 'WARNING', path, round((wd.d - od.d) / od.d * 100, 6) FROM od JOIN wd USING (path) WHERE od.d > 0 AND (wd.d - od.d) / od.d * 100 > 100")


# Tests and reports


@query
def affected_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.affected_tests(D.trade_edges(spark, sf_dir), changed(spark, sf_dir), D.trade_tests(spark, sf_dir))
    return out.select("source", "test", long("distance"))


_AFF = """aw(origin, node, d) AS (SELECT id, id, 0 FROM c UNION SELECT origin, e.src, d + 1 FROM aw JOIN e ON e.dst = node WHERE d < 10 AND (d = 0 OR node NOT IN (SELECT id FROM t))),
aff AS (SELECT origin AS source, node AS test, min(d) AS distance FROM aw WHERE node IN (SELECT id FROM t) GROUP BY 1, 2 HAVING min(d) > 0)"""
sql("affected_tests", _EDGES, _NODES, _CHANGED, _TESTS, _AFF, select="SELECT source, test, CAST(distance AS BIGINT) AS distance FROM aff")


@query
def select_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.select_tests(D.trade_edges(spark, sf_dir), changed(spark, sf_dir), D.trade_tests(spark, sf_dir), 3)
    return out.select("test", long("min_distance"), "hit_count", long("rank"))


sql("select_tests", _EDGES, _NODES, _CHANGED, _TESTS, _AFF, "s AS (SELECT test, min(distance) AS d, count(DISTINCT source) AS h FROM aff GROUP BY test)", "k AS (SELECT *, row_number() OVER (ORDER BY d, h DESC, test) AS rank FROM s)", select="SELECT test, CAST(d AS BIGINT) AS min_distance, h AS hit_count, CAST(rank AS BIGINT) AS rank FROM k WHERE rank <= 3")


@query
def suggest_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, some = D.trade_edges(spark, sf_dir), changed(spark, sf_dir)
    near = impact.impact(edges, some).where("is_direct").select(F.col("affected").alias("id"))
    return selection.suggest_tests(edges, near.union(some).distinct(), D.trade_tests(spark, sf_dir))


sql("suggest_tests", _EDGES, _NODES, _CHANGED, _TESTS, "a AS (SELECT e.src AS id FROM e JOIN c ON e.dst = c.id UNION SELECT id FROM c)", select="SELECT DISTINCT e.src AS test FROM e JOIN t ON e.src = t.id WHERE e.dst IN (SELECT id FROM a) AND e.dst NOT IN (SELECT id FROM t)")


@query
def top_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = D.trade_nodes(spark, sf_dir), D.trade_edges(spark, sf_dir)
    found = impact.impact(edges, changed(spark, sf_dir)).select(F.col("affected").alias("id"))
    return selection.top_affected(found, graph.degrees(nodes, edges))


sql("top_affected", _EDGES, _NODES, _CHANGED, _BACK, _DEGREE, select="SELECT id, in_degree, CASE WHEN in_degree >= 5 THEN 'HIGH' WHEN in_degree >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM deg WHERE id IN (SELECT affected FROM back) ORDER BY in_degree DESC, id LIMIT 10")


@query
def coverage_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, some, tests = D.trade_edges(spark, sf_dir), changed(spark, sf_dir), D.trade_tests(spark, sf_dir)
    return selection.selection_summary(edges, some, tests, selection.select_tests(edges, some, tests, 3))


sql("coverage_confidence", _EDGES, _NODES, _CHANGED, _TESTS, _AFF, _BACK, "s AS (SELECT test, min(distance) AS d, count(DISTINCT source) AS h FROM aff GROUP BY test ORDER BY d, h DESC, test LIMIT 3)", "cv AS (SELECT count(DISTINCT mutated) AS k FROM back WHERE affected IN (SELECT test FROM s))", select="SELECT (SELECT count(*) FROM s) AS selected, (SELECT count(*) FROM t) AS all_tests, round((SELECT count(*) FROM s) / (SELECT count(*) FROM t), 6) AS blast_radius, k AS covered, (SELECT count(*) FROM c) AS changed, round(k / (SELECT count(*) FROM c), 6) AS confidence FROM cv")


# Rows: links of pages as imports, documents as files


@query
def import_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.page_imports(spark, sf_dir)


sql("import_extract", _IMPORTS, select="SELECT path, seq, specifier FROM imp")


@query
def resolve_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links looked up among the paths of all pages; site-relative ones that no page has are unresolved."""
    index = D.table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", r"^[^:]*://[^/?#]*([^?#]*)", 1).alias("specifier")).agg(F.min("page_id").alias("target"))
    local = F.startswith("specifier", F.lit("/"))
    return D.page_imports(spark, sf_dir).join(index, "specifier", "left").select("path", "seq", "specifier", "target", (~local).alias("is_external"), (local & F.col("target").isNull()).alias("is_unresolved"))


sql("resolve_classify", _IMPORTS, select="SELECT path, seq, specifier, target, is_external, is_unresolved FROM dep")


@query
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = resolve_classify(spark, sf_dir).withColumn("c", S.infer_confidence(F.col("is_unresolved")))
    level = F.col("c.confidence")
    return deps.groupBy(level.alias("confidence"), S.confidence_label(level).alias("label"), S.confidence_score(level).alias("score")).agg(F.count(F.lit(1)).alias("dependencies"))


sql("confidence_score", _IMPORTS, select="SELECT CASE WHEN is_unresolved THEN 'unknown' ELSE 'ast' END AS confidence, CASE WHEN is_unresolved THEN '[UNK]' ELSE '[AST]' END AS label, CAST(CASE WHEN is_unresolved THEN 0.0 ELSE 0.85 END AS DOUBLE) AS score, count(*) AS dependencies FROM dep GROUP BY 1, 2, 3")


@query
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = resolve_classify(spark, sf_dir)
    external, unresolved = F.col("is_external"), F.col("is_unresolved")
    text = S.sarif_message(external, F.lit(False), unresolved, F.col("specifier"), F.col("target").cast("string"), F.lit(None).cast("string"))
    return d.select("path", "seq", S.sarif_rule(external, unresolved).alias("rule_id"), S.sarif_level(external, unresolved).alias("level"), text.alias("message"))


sql("sarif_results", _IMPORTS, select="SELECT path, seq, CASE WHEN is_unresolved THEN 'unresolved-dependency' WHEN is_external THEN 'external-dependency' ELSE 'internal-dependency' END AS rule_id, CASE WHEN is_unresolved THEN 'error' WHEN is_external THEN 'warning' ELSE 'note' END AS level, CASE WHEN is_unresolved THEN 'Unresolved dependency: ' || specifier WHEN is_external THEN 'External dependency: ' || specifier ELSE 'Internal dependency: ' || coalesce(CAST(target AS VARCHAR), specifier) END AS message FROM dep")


@query
def convention_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = D.table(spark, sf_dir, "documents").select(F.concat_ws("/", F.when(F.col("doc_id") % 2 == 0, "src"), "source", F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".js").otherwise(".py"))).alias("path"))
    return files.select("path", S.convention_path(F.col("path")).alias("test"))


sql("convention_path", "f AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'src/' ELSE '' END || source || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.js' ELSE '.py' END AS path, source, doc_id FROM documents)", select="SELECT path, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'tests/' || source || '/test_' || doc_id || '.py' ELSE 'tests/test_' || doc_id || '.py' END AS test FROM f")


@query
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of an audit: graph, cycles and upper fifth in one row."""
    nodes, edges = D.trade_nodes(spark, sf_dir), D.trade_edges(spark, sf_dir)
    deg = graph.degrees(nodes, edges)
    report = cycles.cycle_report(nodes, cycles.simple_cycles(edges)).select("total_cycles", "nodes_in_cycles", "severity")
    tops = graph.high_risk(deg).agg(F.count(F.lit(1)).alias("high_risk_files"))
    return deg.agg(F.count(F.lit(1)).alias("total_files"), F.sum("in_degree").alias("total_edges"), F.max("in_degree").alias("max_in_degree")).crossJoin(report).crossJoin(tops)


sql("audit_summary", _EDGES, _NODES, _DEGREE, _CYCLES, "x AS (SELECT count(*) AS c, (SELECT count(DISTINCT id) FROM (SELECT unnest(nodes) AS id FROM cyc)) AS k FROM cyc)", "h AS (SELECT count(*) AS h FROM deg WHERE in_degree >= (SELECT in_degree FROM (SELECT in_degree, row_number() OVER (ORDER BY in_degree, id) AS k FROM deg) WHERE k = (SELECT count(*) - greatest(1, count(*) // 5) FROM n) + 1))", select=f"SELECT (SELECT count(*) FROM n) AS total_files, (SELECT count(*) FROM e) AS total_edges, (SELECT max(in_degree) FROM deg) AS max_in_degree, c AS total_cycles, k AS nodes_in_cycles, {_SEVERITY.format(c='c', p='(k / (SELECT count(*) FROM n) * 100)')} AS severity, h AS high_risk_files FROM x, h")


@query
def mermaid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.trade_edges(spark, sf_dir).select(F.concat(S.safe_id(F.col("src")), F.lit(" -->|"), F.col("seq").cast("string"), F.lit("| "), S.safe_id(F.col("dst"))).alias("line"))


sql("mermaid_lines", _EDGES, select="SELECT src || ' -->|' || seq || '| ' || dst AS line FROM e")


@query
def content_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"))


sql("content_sha1", "x AS (SELECT 1)", select="SELECT doc_id, sha1(text) AS sha1 FROM documents")


@query
def scan_cache_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content no document of a lower source has: what a scan with a cache parses anew."""
    docs = D.table(spark, sf_dir, "documents").select("doc_id", "source", F.sha1(F.col("text").cast("binary")).alias("sha1"))
    cached = docs.where("source < 'src2'").select("sha1").distinct()
    return docs.where("source >= 'src2'").join(cached, "sha1", "left_anti").select("doc_id", "sha1")


sql("scan_cache_anti_join", "d AS (SELECT doc_id, source, sha1(text) AS sha1 FROM documents)", select="SELECT doc_id, sha1 FROM d WHERE source >= 'src2' AND sha1 NOT IN (SELECT sha1 FROM d WHERE source < 'src2')")


@query
def callgraph_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls matched by name alone: line items to suppliers' nations; several definitions make a match polymorphic."""
    calls = D.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("sites"))
    names = D.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    per = names.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("definitions"))
    found = calls.join(names, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.sum("sites").alias("sites"))
    return found.join(per, "s_nationkey").select(F.col("s_nationkey").alias("callee"), "sites", "definitions", (F.col("definitions") > 1).alias("is_polymorphic"))


ORACLE_SQL["callgraph_name_match"] = "SELECT s.s_nationkey AS callee, count(*) AS sites, max(d.k) AS definitions, max(d.k) > 1 AS is_polymorphic FROM lineitem JOIN supplier s ON l_suppkey = s_suppkey JOIN (SELECT s_nationkey, count(*) AS k FROM supplier GROUP BY 1) d ON d.s_nationkey = s.s_nationkey GROUP BY 1"


@query
def event_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and all events in windows of one day, as the stream in topograph.streaming counts them."""
    from topograph.streaming.hotspots import windowed_counts

    return windowed_counts(D.table(spark, sf_dir, "events"), "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "events")


sql("event_hotspots", "x AS (SELECT 1)", select="SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2")
