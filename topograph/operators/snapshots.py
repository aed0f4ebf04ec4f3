"""Snapshots of a graph's metrics, their differences and trend alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def metrics(tag: str, degree: DataFrame, central: DataFrame | None = None) -> DataFrame:
    """(tag, path, in_degree, out_degree, centrality)."""
    rows = degree if central is None else degree.join(central, "id", "left")
    value = F.lit(0.0) if central is None else F.coalesce("betweenness", F.lit(0.0))
    return rows.select(F.lit(tag).alias("tag"), F.col("id").alias("path"), "in_degree", "out_degree", value.alias("centrality"))


def save(root: str, tag: str, metric_rows: DataFrame, edges: DataFrame, cycles: DataFrame, commit: str = "unknown", message: str = "", schema_version: str = "2.1") -> None:
    """Write the tables of one tag under root, in place of what it had."""
    spark = metric_rows.sparkSession
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{root}/{name}/tag={tag}")
    put(metric_rows.drop("tag"), "metrics")
    put(edges.select("src", "dst"), "edges")
    put(cycles.select("nodes", "length"), "cycles")
    meta = spark.range(1).select(F.current_timestamp().alias("saved_at"), F.lit(commit).alias("commit"), F.lit(message).alias("message"), F.lit(schema_version).alias("schema_version"))
    put(meta, "meta")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}").withColumn("tag", F.col("tag").cast("string"))


def list_tags(spark: SparkSession, root: str) -> DataFrame:
    """Saved tags, the latest first."""
    return table(spark, root, "meta").orderBy(F.desc("saved_at"), "tag")


def find_tag(spark: SparkSession, root: str, asked: str) -> str:
    """The tag that is asked, else one dated so, else the first that contains it."""
    rank = F.when(F.col("tag") == asked, 0).when(F.concat_ws("-", F.date_format("saved_at", "yyyy-MM-dd"), "tag") == asked, 1).when(F.contains("tag", F.lit(asked)), 2)
    found = table(spark, root, "meta").withColumn("rank", rank).where("rank is not null").orderBy("rank", F.desc("saved_at"), "tag").first()
    if found is None:
        raise FileNotFoundError(asked)
    return found.tag


def remove_tag(spark: SparkSession, root: str, tag: str) -> None:
    """Leave nothing of a tag."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in ("metrics", "edges", "cycles", "meta"):
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/tag={tag}")
        path.getFileSystem(conf).delete(path, True)


def new_cycles(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Cycles (nodes, from their least node on) that only newer has."""
    return newer.select("nodes").distinct().join(older.select("nodes").distinct(), "nodes", "left_anti")


def diff(older: DataFrame, newer: DataFrame, older_edges: DataFrame, newer_edges: DataFrame, older_cycles: DataFrame, newer_cycles: DataFrame) -> DataFrame:
    """One row of counts and growths between two snapshots' tables (metrics by path, edges, cycles)."""
    both = older.select("path", F.lit(1).alias("o")).join(newer.select("path", F.lit(1).alias("n")), "path", "full")
    files = both.agg(F.count_if(F.expr("o is null")).alias("files_added"), F.count_if(F.expr("n is null")).alias("files_removed"), F.count("o").alias("older_files"), F.count("n").alias("newer_files"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = files.crossJoin(count(older_edges, "older_edges")).crossJoin(count(newer_edges, "newer_edges")).crossJoin(count(new_cycles(older_cycles, newer_cycles), "new_cycles"))
    growth = (F.col("newer_edges") - F.col("older_edges")) / F.greatest("older_edges", F.lit(1)) * 100
    return one.withColumn("edge_growth_pct", F.round(growth, 6))


def trend_alerts(older: DataFrame, newer: DataFrame, older_edges: DataFrame, newer_edges: DataFrame, older_cycles: DataFrame, newer_cycles: DataFrame, growth: float = 30, node_growth: float = 100) -> DataFrame:
    """(kind, severity, subject, value): edges grown by more than growth percent, new cycles, in-degrees grown by more than node_growth."""
    whole = diff(older, newer, older_edges, newer_edges, older_cycles, newer_cycles)
    edges = whole.where((F.col("older_edges") > 0) & (F.col("edge_growth_pct") > growth)).select(F.lit("edge_growth").alias("kind"), F.lit("WARNING").alias("severity"), F.lit("edges").alias("subject"), F.col("edge_growth_pct").alias("value"))
    cycles = whole.where("new_cycles > 0").select(F.lit("new_cycles").alias("kind"), F.lit("CRITICAL").alias("severity"), F.lit("cycles").alias("subject"), F.col("new_cycles").cast("double").alias("value"))
    a, b = older.select("path", F.col("in_degree").alias("old")), newer.select("path", F.col("in_degree").alias("new"))
    pct = F.round((F.col("new") - F.col("old")) / F.col("old") * 100, 6)
    nodes = a.join(b, "path").where("old > 0").withColumn("pct", pct).where(F.col("pct") > node_growth).select(F.lit("in_degree_growth").alias("kind"), F.lit("WARNING").alias("severity"), F.col("path").alias("subject"), F.col("pct").alias("value"))
    return edges.unionByName(cycles).unionByName(nodes)


def largest_growth(older: DataFrame, newer: DataFrame, n: int = 10) -> DataFrame:
    """The n paths whose in-degree grew most."""
    grown = newer.select("path", F.col("in_degree").alias("new")).join(older.select("path", F.col("in_degree").alias("old")), "path", "left").fillna(0).withColumn("growth", F.col("new") - F.col("old"))
    return grown.orderBy(F.desc("growth"), "path").limit(n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("growth"), "path")))  # of n rows
