"""One relational view of files, definitions, imports and calls, and look-ups in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.functions.scalar import clamp_range, owner, overlaps


def definitions(symbols: DataFrame) -> DataFrame:
    """(path, name, fqn, symbol_type, owner, range): a definition's owner is its fqn up to the last dot."""
    return symbols.select("path", "name", "fqn", "symbol_type", owner(F.col("fqn")).alias("owner"), clamp_range(F.coalesce("line", F.lit(1)), F.coalesce("line", F.lit(1))).alias("range"))


def import_edges(deps: DataFrame) -> DataFrame:
    """deps with class: internal, external or unresolved, the last one first."""
    kind = F.when(F.col("is_unresolved"), "unresolved").when(F.col("is_external"), "external").otherwise("internal")
    return deps.withColumn("class", kind)


def find_by_name(symbols: DataFrame, name: str) -> DataFrame:
    return definitions(symbols).where(F.col("name") == name)


def find_by_fqn(symbols: DataFrame, fqn: str) -> DataFrame:
    """The definition of fqn in the last path, as later files overwrite earlier ones."""
    return definitions(symbols).where(F.col("fqn") == fqn).orderBy(F.desc("path")).limit(1)


def definitions_in(symbols: DataFrame, path: str) -> DataFrame:
    return definitions(symbols).where(F.col("path") == path)


def touched(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """(path, fqn): definitions whose lines overlap a hunk (path, start, end) of their file."""
    d = definitions(symbols)
    near = d.join(hunks.select("path", "start", "end"), "path").where(overlaps(F.col("range.start"), F.col("range.end"), F.col("start"), F.col("end")))
    return near.select("path", "fqn").distinct()
