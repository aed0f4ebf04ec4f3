"""Choosing tests for a change, and the report on a pull request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topograph.functions.scalar import convention_path, indegree_level
from topograph.operators.traverse import covers, distances, reversed_edges


def affected_tests(edges: DataFrame, changed: DataFrame, tests: DataFrame, max_depth: int = 10) -> DataFrame:
    """(source, test, distance): tests that reach a changed node, on paths that don't lead through another test."""
    found = distances(reversed_edges(edges), changed, max_depth, closed=tests)
    return found.join(tests.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("origin").alias("source"), F.col("node").alias("test"), "distance")


def convention_tests(changed: DataFrame, tests: DataFrame) -> DataFrame:
    """(source, test): existing tests with the name that convention gives for a changed file."""
    named = changed.select(F.col("id").alias("source"), convention_path(F.col("id")).alias("test")).where("test is not null")
    return named.join(tests.select(F.col("id").alias("test")), "test", "left_semi").select("source", "test")


def select_tests(edges: DataFrame, changed: DataFrame, tests: DataFrame, limit: int = 50) -> DataFrame:
    """(test, min_distance, hit_count, strategy, rank): the first limit tests by distance, then by sources hit, then by name."""
    graph = affected_tests(edges, changed, tests).groupBy("test").agg(F.min("distance").alias("min_distance"), F.count_distinct("source").alias("hit_count"))
    named = convention_tests(changed, tests).select("test").distinct().join(graph, "test", "left_anti").select("test", F.lit(999).alias("min_distance"), F.lit(1).cast("long").alias("hit_count"))
    both = graph.withColumn("strategy", F.lit("graph")).unionByName(named.withColumn("strategy", F.lit("convention")))
    first = both.orderBy("min_distance", F.desc("hit_count"), "test").limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("min_distance", F.desc("hit_count"), "test")))


def select_tests_by_file(nodes: DataFrame, edges: DataFrame, changed: DataFrame, tests: DataFrame, limit: int = 50) -> DataFrame:
    """(test): without a diff, tests among the changed files and what they affect, by name; convention for files outside the graph."""
    known = changed.join(nodes.select("id"), "id", "left_semi")
    hit = distances(reversed_edges(edges), known).select(F.col("node").alias("id")).union(known.select("id"))
    outside = convention_tests(changed.join(nodes.select("id"), "id", "left_anti"), tests).select(F.col("test").alias("id"))
    return hit.union(outside).distinct().join(tests.select("id"), "id", "left_semi").orderBy("id").limit(limit).select(F.col("id").alias("test"))


def selection_summary(edges: DataFrame, changed: DataFrame, tests: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: selected and all tests, their share, and the share of changed files that a selected test covers."""
    chosen = selected.select(F.col("test").alias("id"))
    covered = covers(edges, chosen, changed).agg(F.count_distinct("source").alias("covered"))
    counts = chosen.agg(F.count(F.lit(1)).alias("selected")).crossJoin(tests.agg(F.count(F.lit(1)).alias("all_tests"))).crossJoin(covered).crossJoin(changed.select("id").distinct().agg(F.count(F.lit(1)).alias("changed")))
    share = lambda a, b: F.coalesce(F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6), F.lit(0.0))
    return counts.select("selected", "all_tests", share("selected", "all_tests").alias("blast_radius"), "covered", "changed", share("covered", "changed").alias("confidence"))


def suggest_tests(edges: DataFrame, affected: DataFrame, tests: DataFrame) -> DataFrame:
    """(test): tests with an edge to an affected node that is no test itself."""
    targets = affected.join(tests, "id", "left_anti").select(F.col("id").alias("dst"))
    near = edges.join(targets, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return near.join(tests, "id", "left_semi").select(F.col("id").alias("test"))


def top_affected(affected: DataFrame, degree: DataFrame, n: int = 10) -> DataFrame:
    """(id, in_degree, level): the n affected nodes that most nodes depend on."""
    rows = affected.select("id").distinct().join(degree, "id").select("id", "in_degree", indegree_level(F.col("in_degree")).alias("level"))
    return rows.orderBy(F.desc("in_degree"), "id").limit(n)
