"""Relations that stand in for a scanned project when only the driver's tables are at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topograph.functions.scratch import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, day, units): what customers of nation src bought from suppliers of nation dst, in units of 0.0001.

    Small dimensions are left to the planner's own size-checked broadcast.
    Units are whole numbers, so sums don't depend on their order.
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("src"))
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("dst"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.to_date("l_shipdate").alias("day"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000).cast("long").alias("units"))
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return bought.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).where("src <> dst").select("src", "dst", "day", "units")


def ranked_edges(sold: DataFrame, keep: int = 3) -> DataFrame:
    """(src, dst, seq): for each src its keep best dst, ties by name; seq is the rank."""
    total = sold.groupBy("src", "dst").agg(F.sum("units").alias("units"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("units"), "dst"))
    return total.withColumn("seq", rank).where(F.col("seq") <= keep).select("src", "dst", "seq")


def trade_edges(spark: SparkSession, sf_dir: str, keep: int = 3) -> DataFrame:
    """The dependency graph: 25 nations, each on three others."""
    return materialize(ranked_edges(sales(spark, sf_dir), keep), "trade")


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"))


def trade_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of region 0 play the tests."""
    return table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_name").alias("id"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit, ts, is_fix): orders; urgent ones play the bug fixes."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("ts"), (F.col("o_orderpriority") == "1-URGENT").alias("is_fix"))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, size_bytes): documents play the files."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), F.col("n_chars").alias("size_bytes"))


def page_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, seq, specifier): the links of each page, in order."""
    pages = table(spark, sf_dir, "pages")
    found = pages.select(F.col("page_id").alias("path"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("seq", "specifier"))
    return found.select("path", F.col("seq").cast("long").alias("seq"), "specifier")
