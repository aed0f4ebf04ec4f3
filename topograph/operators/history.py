"""Commit history: hotspots, bug-fix rates and files that change together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topograph.functions.scalar import is_bug_fix


def since(commits: DataFrame, days: int = 90, now: Column | None = None) -> DataFrame:
    """Commits of the last days before now, or before the latest commit."""
    if now is not None:
        return commits.where(F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS"))
    latest = commits.agg(F.max("ts").alias("latest"))
    return commits.crossJoin(F.broadcast(latest)).where(F.expr(f"ts >= latest - INTERVAL {days} DAYS")).drop("latest")


def commit_flags(commits: DataFrame) -> DataFrame:
    """commits with is_fix by their subject."""
    return commits.withColumn("is_fix", is_bug_fix(F.col("subject")))


def co_changes(commit_files: DataFrame, least: int = 2, most: int = 20) -> DataFrame:
    """(path, other) ordered pairs of files of one commit, over commits of least to most files.

    A commit gives at most most * (most - 1) pairs, so the join is bounded by
    the commits.
    """
    each = commit_files.select("commit", "path").distinct()
    fit = each.groupBy("commit").agg(F.array_sort(F.collect_set("path")).alias("files"), F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most))
    one = fit.select("files", F.explode("files").alias("path"))
    return one.select("path", F.explode("files").alias("other")).where("path <> other").distinct()


def hotspots(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """One row for each path: commits, bug fixes, their rate, churn and whether it is a hotspot.

    commits (commit, is_fix), commit_files (commit, path). A hotspot's rate is
    over twice the project's. co_change_count counts the hotspots that a path
    changed together with.
    """
    pairs = commit_files.select("commit", "path").distinct().join(commits.select("commit", "is_fix"), "commit")
    files = pairs.groupBy("path").agg(F.count(F.lit(1)).alias("total_commits"), F.count_if("is_fix").alias("bug_fix_commits"))
    all_ = files.agg(F.sum("bug_fix_commits").alias("fixes"), F.sum("total_commits").alias("commits"), F.count(F.lit(1)).alias("files"))
    rate = F.col("bug_fix_commits") / F.greatest("total_commits", F.lit(1))
    average = F.col("fixes") / F.greatest("commits", F.lit(1))
    churn = F.least(F.col("total_commits") / F.greatest(F.col("commits") / F.greatest("files", F.lit(1)), F.lit(1.0)), F.lit(3.0))
    rows = files.crossJoin(F.broadcast(all_)).select("path", "total_commits", "bug_fix_commits", F.col("total_commits").alias("churn_count"), rate.alias("bug_fix_rate"), churn.alias("churn_frequency"), (rate > 2 * average).alias("is_hotspot"))
    hot = rows.where("is_hotspot").select(F.col("path").alias("other"))
    company = co_changes(commit_files).join(hot, "other", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("co"))
    return rows.join(company, "path", "left").withColumn("co_change_count", F.coalesce("co", F.lit(0))).drop("co")


def hotspot_of(found: DataFrame, path: str) -> DataFrame:
    """The row of one path, all zero if it has no history."""
    spark = found.sparkSession
    asked = spark.createDataFrame([(path,)], "path string").join(found, "path", "left")
    zero = {c: (False if t == "boolean" else 0) for c, t in found.dtypes if c != "path"}
    return asked.fillna(zero)


def fresh(cached: DataFrame, now: Column | None = None, days: int = 7) -> DataFrame:
    """Cached hotspot rows (computed_at) younger than days."""
    return cached.where(F.col("computed_at") > (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {days} DAYS"))
