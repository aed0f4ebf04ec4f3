"""Node and edge tables: building, deduplication, degrees and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topograph.functions.scalar import language_of, suffix_of


def dedupe_edges(edges: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each (src, dst): the last one by order, as later imports overwrite earlier ones."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    last = F.max(F.struct(order, *(c for c in rest if c != order)))
    return edges.groupBy("src", "dst").agg(last.alias("x")).select("src", "dst", *(F.col("x")[c].alias(c) for c in rest))


def internal_edges(deps: DataFrame) -> DataFrame:
    """Edges (src, dst, seq, kind, line, confidence, confidence_source, resolved_by) of resolved internal dependencies."""
    found = deps.where("not is_external and target_path is not null")
    by = F.when(language_of(F.col("path")) != "unknown", language_of(F.col("path")))
    resolved = F.coalesce(by, F.when(language_of(F.col("target_path")) != "unknown", language_of(F.col("target_path"))), F.lit("python"))
    return dedupe_edges(found.select(F.col("path").alias("src"), F.col("target_path").alias("dst"), "seq", "kind", "line", "confidence", "confidence_source", resolved.alias("resolved_by")))


def ghosts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that edges point at but nodes doesn't have."""
    return edges.select(F.col("dst").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")


def file_nodes(files: DataFrame, deps: DataFrame, symbols: DataFrame) -> DataFrame:
    """Node rows of scanned files with their counts, and of the files that are only imported."""
    per_file = deps.groupBy("path").agg(F.count_if("is_unresolved").alias("unresolved_count"), F.count_if("is_external").alias("external_count"), F.count(F.lit(1)).alias("n_deps"))
    per_symbol = symbols.groupBy("path").agg(F.count(F.lit(1)).alias("symbol_count"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    own = files.join(per_file, "path", "left").join(per_symbol, "path", "left").where("error is null or n_deps > 0")
    own = own.select(F.col("path").alias("id"), "language", "suffix", "size_bytes", zero("symbol_count"), zero("unresolved_count"), zero("external_count"), F.lit(False).alias("is_ghost"))
    none = F.lit(0).cast("long")
    missing = ghosts(own, internal_edges(deps)).select("id", language_of(F.col("id")).alias("language"), suffix_of(F.col("id")).alias("suffix"), none.alias("size_bytes"), none.alias("symbol_count"), none.alias("unresolved_count"), none.alias("external_count"), F.lit(True).alias("is_ghost"))
    return own.unionByName(missing)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of every node, by distinct edges."""
    one = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    ends = edges.select(F.col("dst").alias("id"), one.alias("i"), zero.alias("o")).union(edges.select(F.col("src").alias("id"), zero.alias("i"), one.alias("o")))
    both = nodes.select("id", zero.alias("i"), zero.alias("o"), F.lit(True).alias("known")).union(ends.withColumn("known", F.lit(False)))
    total = both.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.bool_or("known").alias("known"))
    return total.where("known").select("id", "in_degree", "out_degree")


def top(degree: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n nodes with the greatest positive value of column, ties by id."""
    return degree.where(F.col(column) > 0).select("id", column).orderBy(F.desc(column), "id").limit(n)


def high_risk(degree: DataFrame) -> DataFrame:
    """Nodes whose in-degree reaches that of the upper fifth.

    The threshold is the k-th smallest in-degree, k = n - max(1, n // 5); it is
    found on the histogram of degrees, which has few rows at any size.
    """
    histogram = degree.groupBy("in_degree").agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.orderBy("in_degree").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = histogram.agg(F.sum("n").alias("total"))
    running = histogram.withColumn("seen", F.sum("n").over(up_to)).crossJoin(F.broadcast(total))
    rank = F.col("total") - F.greatest(F.lit(1), F.floor(F.col("total") / 5))
    threshold = running.where(F.col("seen") > rank).agg(F.min("in_degree").alias("threshold"))
    return degree.crossJoin(F.broadcast(threshold)).where("in_degree >= threshold").select("id", "in_degree")


def graph_stats(nodes: DataFrame, edges: DataFrame, deps: DataFrame, files: DataFrame) -> DataFrame:
    """One row of totals. total_edges is of distinct internal edges; the others are counts of dependencies."""
    one = nodes.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("symbol_count"), F.lit(0)).alias("total_symbols"), F.count_if("is_ghost").alias("ghost_files"))
    two = edges.agg(F.count(F.lit(1)).alias("total_edges"))
    three = deps.agg(F.count_if(F.expr("not is_external")).alias("internal_dependencies"), F.count_if("is_external").alias("external_dependencies"), F.count_if("is_unresolved").alias("unresolved_dependencies"))
    four = files.agg(F.count(F.lit(1)).alias("scanned_files"), F.count_if(F.expr("error is not null")).alias("failed_files"))
    return one.crossJoin(two).crossJoin(three).crossJoin(four)


def language_breakdown(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))


def resolved_share(deps: DataFrame) -> Column:
    return F.round(F.count_if(F.expr("target_path is not null")) / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100, 6)
