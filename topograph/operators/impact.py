"""Impact of changed nodes: who depends on them, over how many hops, and what share of the graph that is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topograph.operators.components import connected_components
from topograph.operators.reach import reach
from topograph.operators.traverse import chain_paths, chain_steps, distances, reversed_edges


def impact(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(mutated, affected, distance, is_direct) for the nodes of changed (id)."""
    found = distances(reversed_edges(edges), changed)
    return found.select(F.col("origin").alias("mutated"), F.col("node").alias("affected"), "distance", (F.col("distance") == 1).alias("is_direct"))


def impact_chains(edges: DataFrame, changed: DataFrame, max_chains: int = 50) -> DataFrame:
    """(mutated, affected, length, chain) for the first max_chains affected nodes of each changed one; a chain runs from affected to mutated. Only their chains are put together."""
    steps = chain_steps(reversed_edges(edges), changed)
    rank = F.row_number().over(Window.partitionBy("origin").orderBy("node"))
    wanted = steps.where("distance > 0").withColumn("n", rank).where(F.col("n") <= max_chains)
    found = chain_paths(steps, wanted)
    return found.select(F.col("origin").alias("mutated"), F.col("node").alias("affected"), F.col("distance").alias("length"), F.reverse("path").alias("chain"))


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, size) of the weakly connected components."""
    found = connected_components(edges.where("src <> dst"))
    all_ = nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return all_.join(all_.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("id", "component", "size")


def impact_per_node(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(mutated, directly_affected, total_affected, blast_component, blast_project) for each changed node of the graph.

    blast_component relates the node and what it affects to its weak
    component, blast_project to all nodes, in percent. A node that isn't in
    the graph affects nothing and has 0.
    """
    direct = edges.where("src <> dst").select("src", "dst").distinct().groupBy(F.col("dst").alias("mutated")).agg(F.count(F.lit(1)).alias("direct"))
    found = reach(reversed_edges(edges), changed).counts().select(F.col("id").alias("mutated"), F.col("reached").alias("total")).join(direct, "mutated", "left")
    sizes = component_sizes(nodes, edges)
    total = nodes.agg(F.count(F.lit(1)).alias("n"))
    rows = changed.select(F.col("id").alias("mutated")).distinct().join(found, "mutated", "left").join(sizes.withColumnRenamed("id", "mutated"), "mutated", "left").crossJoin(F.broadcast(total))
    zero = F.lit(0).cast("long")
    share = lambda of: F.when(F.col("size").isNull(), 0.0).otherwise((F.coalesce("total", zero) + 1) / of * 100)
    return rows.select("mutated", F.coalesce("direct", zero).alias("directly_affected"), F.coalesce("total", zero).alias("total_affected"), share(F.col("size")).alias("blast_component"), share(F.col("n")).alias("blast_project"))


def impact_together(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """One row for all changed nodes: (mutated, affected, blast_radius); blast_radius is of their union in percent of all nodes."""
    known = changed.join(nodes.select("id"), "id", "left_semi").select("id").distinct()
    found = impact(edges, known).select(F.col("affected").alias("id"))
    union = found.union(known).distinct().agg(F.count(F.lit(1)).alias("union_size"))
    counts = found.distinct().agg(F.count(F.lit(1)).alias("affected")).crossJoin(known.agg(F.count(F.lit(1)).alias("mutated"))).crossJoin(union).crossJoin(nodes.agg(F.count(F.lit(1)).alias("n")))
    return counts.select("mutated", "affected", F.coalesce(F.try_divide("union_size", "n") * 100, F.lit(0.0)).alias("blast_radius"))
