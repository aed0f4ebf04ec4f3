"""Output of git as tables: changed files, status, log. Lines carry forward what stands above them by windows."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def run_git(root: str, *args: str, timeout: int = 60) -> str:
    """Output of a git command; an empty string if it fails."""
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout)
    return done.stdout if done.returncode == 0 else ""


def is_repository(root: str) -> bool:
    return run_git(root, "rev-parse", "--is-inside-work-tree", timeout=10).strip() == "true"


def head(root: str) -> tuple[str, str]:
    """Short hash and first line of the current commit."""
    commit, _, message = run_git(root, "log", "-1", "--format=%h%x00%s", "--abbrev=8").strip().partition("\0")
    return (commit, message) if commit else ("unknown", "")


def changed_files(spark: SparkSession, root: str, staged: bool = False, ref: str | None = None) -> DataFrame:
    """(path) of files changed in the work tree, the index, or since ref; none if git fails."""
    if staged and ref:
        raise ValueError("staged and ref exclude each other")
    args = ["--cached"] if staged else [f"{ref}...HEAD"] if ref else []
    names = [x for x in run_git(root, "diff", "--name-only", *args, timeout=30).splitlines() if x]
    return spark.createDataFrame([(x,) for x in names], "path string")


def lines(spark: SparkSession, text: str) -> DataFrame:
    """(line_no, text), numbered from 1."""
    return spark.createDataFrame([(text,)], "all string").select(F.posexplode(F.split("all", "\n")).alias("n", "text")).select((F.col("n") + 1).alias("line_no"), "text")


def branch(root: str) -> str:
    """The current branch; HEAD if none is checked out, unknown without git."""
    return run_git(root, "rev-parse", "--abbrev-ref", "HEAD", timeout=10).strip() or "unknown"


def status(spark: SparkSession, root: str) -> DataFrame:
    """(branch, staged, unstaged, untracked) of a work tree."""
    rows = [(x,) for x in run_git(root, "status", "--porcelain", timeout=30).splitlines() if x]
    return status_summary(spark.createDataFrame(rows, "text string")).select(F.lit(branch(root)).alias("branch"), "staged", "unstaged", "untracked")


def status_summary(status: DataFrame) -> DataFrame:
    """(staged, unstaged, untracked) counts of porcelain lines (text)."""
    index, tree = F.substring("text", 1, 1), F.substring("text", 2, 1)
    return status.agg(F.count_if(index.isin(*"MADRC")).alias("staged"), F.count_if(tree.isin(*"MDRC")).alias("unstaged"), F.count_if(F.startswith("text", F.lit("??"))).alias("untracked"))


def parse_log(log: DataFrame, order: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """(commit, author, ts, subject) and (commit, path) of lines "HASH EMAIL DATE SUBJECT", each followed by its files.

    A header starts with 40 hex digits. Further columns of log, such as a
    file's name, part independent logs.
    """
    keys = [c for c in log.columns if c not in (order, "text")]
    is_head = F.col("text").rlike("^[0-9a-f]{40} ")
    above = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = log.withColumn("commit", F.last(F.when(is_head, F.substring("text", 1, 40)), ignorenulls=True).over(above))
    part = lambda i: F.regexp_extract("text", r"^([0-9a-f]{40}) (\S+) (\S+) ?(.*)$", i)
    commits = log.where(is_head).select(part(1).alias("commit"), part(2).alias("author"), F.try_to_timestamp(part(3)).alias("ts"), part(4).alias("subject"))
    files = marked.where(~is_head & (F.trim("text") != "") & F.col("commit").isNotNull()).select("commit", F.trim("text").alias("path"))
    return commits, files
