"""Operator 2: URL filtering by a sorted array of digests.

Rules (verdict, host, path) are keyed by host + path. Their 64-bit digests are
sorted into one flat file and the strings into another, which every executor
gets as a file of its own and maps into memory. A URL asks for its host and
all parent domains, each with the starts of its path that are as long as some
rule's path, in one vectorised binary search; a hit counts only if the stored
string is the same.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Rule = tuple[str, str, str]
PARTS = ("keys", "ends", "allow", "text", "paths")


class DigestArray:
    """The mapped files: digests in order, then for each its verdict and its place among the strings."""

    def __init__(self, folder: str, name: str):
        self.digests = np.memmap(os.path.join(folder, name + ".keys"), np.uint64, "r")
        self.ends = np.memmap(os.path.join(folder, name + ".ends"), np.int64, "r")
        self.allow = np.memmap(os.path.join(folder, name + ".allow"), np.uint8, "r")
        self.strings = np.memmap(os.path.join(folder, name + ".text"), np.uint8, "r")
        #: lengths that rules' paths have, and the longest host of a rule
        self.lengths = np.memmap(os.path.join(folder, name + ".paths"), np.int32, "r").tolist()
        self.longest = self.lengths.pop()

    def string(self, i: int) -> bytes:
        return self.strings[self.ends[i - 1] if i else 0 : self.ends[i]].tobytes()

    def find(self, keys: list[bytes], hashes: np.ndarray | None = None) -> np.ndarray:
        """The index of each key, or -1; digests that only collide are passed over."""
        if hashes is None:
            hashes = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, hashes)
        out = np.full(len(keys), -1, np.int64)
        for j in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == hashes) if len(self.digests) else ():
            i = int(at[j])
            while i < len(self.digests) and self.digests[i] == hashes[j]:
                if self.string(i) == keys[j]:
                    out[j] = i
                    break
                i += 1
        return out


def write_digests(rules: Iterable[Rule], folder: str) -> str:
    """Write the files of rules into folder and return their common name. A null host or path counts as empty; of equal rules a block wins."""
    merged: dict[bytes, tuple[int, int]] = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        host, path = (host or "").lower(), path or ""
        key = (host + "\0" + path).encode()
        merged[key] = min(merged.get(key, (1, 0)), (int(verdict == "allow"), 0))
    order = sorted(merged, key=lambda k: (xxhash.xxh64_intdigest(k), k))
    name = "digests-" + hashlib.sha256(b"\n".join(k + b"\1%d" % merged[k][0] for k in order)).hexdigest()[:24]
    parts = {
        "keys": np.array([xxhash.xxh64_intdigest(k) for k in order], np.uint64),
        "ends": np.cumsum([len(k) for k in order]).astype(np.int64),
        "allow": np.array([merged[k][0] for k in order], np.uint8),
        "text": np.frombuffer(b"".join(order), np.uint8),
        "paths": np.array([*sorted({len(k.partition(b"\0")[2].decode()) for k in order}), max((len(k.partition(b"\0")[0].decode()) for k in order), default=0)], np.int32),
    }
    for part, values in parts.items():
        # an empty file can't be mapped
        (values if len(values) else np.zeros(1, values.dtype) if part == "text" else np.array([-1]).astype(values.dtype)).tofile(os.path.join(folder, f"{name}.{part}"))
    return name


_SHIPPED: set[tuple[str, str]] = set()


def _ship(spark: SparkSession, rules: Iterable[Rule]) -> str:
    """Hand the files to every executor, once for each application; the driver serves them from a folder that stays."""
    folder = tempfile.mkdtemp(prefix="digests-")
    name = write_digests(rules, folder)
    context = spark.sparkContext
    if (context.applicationId, name) not in _SHIPPED:
        for part in PARTS:
            context.addFile(os.path.join(folder, f"{name}.{part}"))
        _SHIPPED.add((context.applicationId, name))
    return name


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(_part(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return _part(url, 2)


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of pages.

    host is what stands between the first :// and the next / ? # or the end,
    with A-Z lower-cased; path goes on to the next ? # or the end; both are
    empty for a null url or one without ://. A rule fits its host and all
    subdomains if the path starts with the rule's. The longest rule (host and
    path together, then the longer host) wins. Without one, rule is null and
    the verdict is default: a URL that the array doesn't hold is not blocked.
    Rows that repeat, or have a null id, are judged each; an empty table gives
    no rows; of a URL of any length only what some rule could fit is looked up.
    Other columns play no part.
    """
    spark = pages.sparkSession
    name = _ship(spark, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.getRootDirectory(), name)
        for batch in batches:
            asked: dict[bytes, int] = {}
            wants: list[list[tuple[int, int, int]]] = []
            known: dict[tuple[str, str], list[tuple[int, int, int]]] = {}
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                starts = tuple(n for n in array.lengths if n <= len(path))
                key = host, path[: starts[-1]] if starts else ""
                mine = known.get(key)
                if mine is None:
                    mine = []
                    dot = len(host)
                    while dot >= 0:  # the host and its parents, the shortest first
                        dot = host.rfind(".", 0, dot)
                        domain = host[dot + 1 :]
                        if len(domain) > array.longest:
                            break
                        for n in starts:
                            q = asked.setdefault((domain + "\0" + path[:n]).encode(), len(asked))
                            mine.append((len(domain) + n, len(domain), q))
                    known[key] = mine
                wants.append(mine)
            found = array.find(list(asked))
            out: tuple[list, list] = [], []
            for mine in wants:
                hits = [(size, length, int(found[q])) for size, length, q in mine if found[q] >= 0]
                if hits:
                    at = max(hits)[2]
                    out[0].append(array.string(at).decode().replace("\0", ""))
                    out[1].append("allow" if array.allow[at] else "block")
                else:
                    out[0].append(None)
                    out[1].append(default)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), batch.column("path"), pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], ["id", "host", "path", "rule", "verdict"])

    given = pages.select(F.col(id_col).cast("long").alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return given.mapInArrow(run, "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
