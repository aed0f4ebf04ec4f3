"""Source files as a table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topograph.functions.scalar import basename, language_of, matches_any, rel_path, suffix_of
from topograph.functions.scratch import materialize
from topograph.sources.config import Config


def ignored(path: Column, config: Config) -> Column:
    """Whether a folder on the way to path, or its own name, is to be left out."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.exists(folders, lambda d: matches_any(d, config.ignore_dirs)) | matches_any(basename(path), config.ignore_files)


def can_scan(path: Column) -> Column:
    """Whether a parser takes the file; declaration files of TypeScript hold no code."""
    return (language_of(path) != "unknown") & ~F.endswith(path, F.lit(".d.ts"))


def _store(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(place, path, size_bytes, mtime) of all files below root.

    Names are listed by the driver, as Spark's own file sources do; those leave
    out empty files and names that begin with _ or ., such as __init__.py.
    """
    system, base = _store(root)
    found = [x for x in system.get_file_info(fs.FileSelector(base, recursive=True)) if x.is_file]
    places = pa.table({"place": pa.array([x.path for x in found], pa.string()), "size_bytes": pa.array([x.size for x in found], pa.int64()), "mtime": pa.array([x.mtime for x in found], pa.timestamp("us", "UTC"))})
    listed = spark.createDataFrame(places)
    return listed.select("place", rel_path(F.col("place"), base).alias("path"), "size_bytes", "mtime")


def read_tree(spark: SparkSession, root: str, config: Config = Config()) -> DataFrame:
    """(path, content, size_bytes, mtime, sha1, suffix, language, is_script, skipped) of the files below root that parsers take.

    Files over the size limit come with skipped = true and no content; names
    are filtered before any content is read. Tasks open the files on their own,
    so root must be a store that all of them see; a file that is gone by then
    has no content.
    """
    path = F.col("path")
    large = F.floor(F.col("size_bytes") / 1024) > config.max_file_size_kb
    rows = list_tree(spark, root).where(~ignored(path, config) & can_scan(path)).withColumn("skipped", large)
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _store(root)
        for batch in batches:
            for k, (place, skipped) in enumerate(zip(batch.column("place").to_pylist(), batch.column("skipped").to_pylist(), strict=True)):
                content = None
                if not skipped:
                    try:
                        with system.open_input_stream(place) as f:
                            content = f.read()
                    except FileNotFoundError:
                        pass
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([row.column(c) for c in names] + [pa.array([content], pa.binary())], [*names, "content"])

    names = ["path", "size_bytes", "mtime", "skipped"]
    read = rows.mapInArrow(run, "path string, size_bytes long, mtime timestamp, skipped boolean, content binary")
    return read.select("path", "content", "size_bytes", "mtime", F.sha1("content").alias("sha1"), suffix_of(path).alias("suffix"), language_of(path).alias("language"), F.startswith(F.col("content").cast("string"), F.lit("#!")).alias("is_script"), "skipped")


def subset(files: DataFrame, changed: DataFrame) -> DataFrame:
    """The files whose path is among changed (path); resolve against the index of all files."""
    return files.join(changed.select("path").distinct(), "path", "left_semi")


def to_parse(files: DataFrame, cache: DataFrame) -> DataFrame:
    """The files whose content the cache (path, sha1, ...) doesn't know."""
    return files.join(cache.select("path", "sha1").distinct(), ["path", "sha1"], "left_anti")


def cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """The cache's rows of files that haven't changed."""
    return cache.join(files.select("path", "sha1"), ["path", "sha1"], "left_semi")


def refresh_cache(cache: DataFrame, files: DataFrame, parsed: DataFrame) -> DataFrame:
    """The cache for the next scan: what still holds and what was parsed anew; rows of files that are gone drop out."""
    return cached(files, cache).unionByName(parsed)


#: Buckets of a stored cache; one of another number is read as none and made anew.
BUCKETS = 256


def bucket_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def touched_buckets(old: DataFrame, new: DataFrame) -> DataFrame:
    """(bucket) of files that only one of two caches (path, sha1, ...) knows, or knows with that content."""
    a, b = old.select("path", "sha1").distinct(), new.select("path", "sha1").distinct()
    changed = a.join(b, ["path", "sha1"], "left_anti").union(b.join(a, ["path", "sha1"], "left_anti"))
    return changed.select(bucket_of(F.col("path")).alias("bucket")).distinct()


def store_cache(new: DataFrame, path: str, old: DataFrame | None = None) -> None:
    """Write a cache by buckets of the path's hash; with the one stored there (old), only buckets in which a file came, went or changed.

    new must not read from path. A bucket that is left without files holds one
    row of nulls, as a folder can't be overwritten by nothing.
    """
    rows = new.withColumn("bucket", bucket_of(F.col("path")))
    mode = "static"
    if old is not None:
        touched = materialize(touched_buckets(old, new), "touched")
        if touched.isEmpty():
            return
        emptied = touched.join(rows.select("bucket").distinct(), "bucket", "left_anti")
        rows = rows.join(touched, "bucket", "left_semi").unionByName(emptied, allowMissingColumns=True)
        mode = "dynamic"
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(path)


def stored_cache(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The rows that store_cache left at path; None if there are none, if they can't be read or lie in other buckets."""
    try:
        found = spark.read.schema(f"{schema}, bucket int").parquet(path)
        wrong = F.coalesce(F.col("bucket") != bucket_of(F.col("path")), F.col("bucket").isNull())
        first = found.agg(F.count(F.lit(1)), F.count_if(wrong & (F.col("path").isNotNull() | F.col("bucket").isNull()))).first()
    except (AnalysisException, PySparkException, Py4JJavaError):
        return None
    return None if first[0] == 0 or first[1] > 0 else found.where("path is not null").drop("bucket")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("rows"))
