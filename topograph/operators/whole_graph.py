"""Shortest paths from many sources in tasks that each have the whole graph before them, as three flat files in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.functions.scratch import materialize, scratch_path

#: Edges up to which a graph is held by tasks: 4 bytes each, mapped where the folder is a local one.
WHOLE = 100_000_000
#: Steps along edges that a task takes at once.
STEPS = 1 << 21


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    return (fs.LocalFileSystem(use_mmap=True), path) if isinstance(system, fs.LocalFileSystem) else (system, path)


def _read(uri: str, kind: str) -> np.ndarray:
    system, path = _opened(uri)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)


def _write(uri: str, *arrays: np.ndarray) -> None:
    system, path = _opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        for x in arrays:
            out.write(x)


def _table(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    every = list(batches)
    return {c: np.concatenate([b.column(c).to_numpy() for b in every]) for c in every[0].schema.names} if every else {}


@dataclass
class WholeGraph:
    """names (id, h): the nodes and their hashes; folder: has hashes, sorted, first, the place of each node's first edge, and to, the places of the nodes that edges lead to."""

    names: DataFrame
    folder: str


def whole_graph(nodes: DataFrame, edges: DataFrame, whole: int | None = None) -> WholeGraph | None:
    """The graph of nodes (id) and edges (src, dst) as flat files; None if it has more than `whole` edges, WHOLE by default, or two nodes of one hash."""
    spark = nodes.sparkSession
    e = edges.where("src <> dst").select(F.xxhash64("src").alias("s"), F.xxhash64("dst").alias("d"))
    if edges.count() > (WHOLE if whole is None else whole):
        return None
    ids = nodes.select("id").union(edges.select("src")).union(edges.select("dst")).where("id is not null").distinct()
    names = materialize(ids.select("id", F.xxhash64("id").alias("h")), "names")
    n, hashes = names.agg(F.count(F.lit(1)), F.count_distinct("h")).first()
    if n != hashes:
        return None
    folder = scratch_path(spark, "graph")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _write(f"{folder}/hashes", np.sort(_table(batches).get("h", np.zeros(0, np.int64))))
        yield pa.RecordBatch.from_arrays([pa.array([1])], ["done"])

    materialize(names.select("h").repartition(1).mapInArrow(sort, "done long"), "sorted")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = F.floor((F.col("s") / 2.0**64 + 0.5) * parts).cast("int")  # grows with the hash

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        if not t:
            return
        places = _read(f"{folder}/hashes", "<i8")
        pairs = np.unique(np.searchsorted(places, t["s"]) << 32 | np.searchsorted(places, t["d"]))
        shares = np.floor((places[pairs >> 32] / 2.0**64 + 0.5) * parts).astype(np.int64)
        for x in np.unique(shares):
            mine = pairs[shares == x]
            _write(f"{folder}/pairs-{x}", mine)
            yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([len(mine)])], ["share", "n"])

    made = sorted(r.share for r in materialize(e.where("s is not null and d is not null").repartition(parts, share).mapInArrow(lines, "share long, n long"), "lines").collect())

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        list(batches)
        many = np.zeros(n + 1, np.int64)
        system, path = _opened(f"{folder}/to")
        with system.open_output_stream(path) as out:
            for x in made:
                pairs = _read(f"{folder}/pairs-{x}", "<i8")
                low, high = pairs[0] >> 32, pairs[-1] >> 32
                many[low + 1 : high + 2] += np.bincount((pairs >> 32) - low, minlength=high - low + 1)
                out.write((pairs & 0xFFFFFFFF).astype("<i4"))
                _opened(f"{folder}/pairs-{x}")[0].delete_file(_opened(f"{folder}/pairs-{x}")[1])
        _write(f"{folder}/first", np.cumsum(many))
        yield pa.RecordBatch.from_arrays([pa.array([1])], ["done"])

    materialize(spark.range(1).repartition(1).mapInArrow(join, "done long"), "joined")
    return WholeGraph(names, folder)


def _pieces(first: np.ndarray, to: np.ndarray, n: int, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, step): the steps from the rows of at, a source and a node in one number each, of some STEPS at a time; owner is a row's place."""
    node = at % n
    many = first[node + 1] - first[node]
    ends = np.cumsum(many)
    low = 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + STEPS, "right")))
        k = many[low:high]
        owner = np.repeat(np.arange(low, high), k)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(k) - k, k)
        if len(owner):
            yield owner, to[first[node[owner]] + inner] + (at - node)[owner]
        low = high


def _summed(step: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, paths, place): the different steps, sorted, the paths of each, and where each row's is."""
    order = np.argsort(step)
    s = step[order]
    fresh = np.concatenate([[True], s[1:] != s[:-1]])
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return s[fresh], np.bincount(place, paths), place


def shares(first: np.ndarray, to: np.ndarray, n: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(node, delta, steps): for each of starts and each other node that it reaches, the shares of the shortest paths that the node stands within (Brandes 2001)."""
    at, paths, steps = np.arange(len(starts)) * n + starts, np.ones(len(starts)), 0
    seen, levels = at, []
    while len(at):
        found: list[tuple[np.ndarray, np.ndarray]] = []
        kept = None
        for i, (owner, step) in enumerate(_pieces(first, to, n, at)):
            steps += len(step)
            codes, p, place = _summed(step, paths[owner])
            kept = (owner, place, len(codes)) if not i else None
            found.append((codes, p))
            if len(found) > 8:
                found = [_summed(*map(np.concatenate, zip(*found, strict=True)))[:2]]
        if not found:
            levels.append((at, paths, None, None))
            break
        codes, p = found[0] if len(found) == 1 else _summed(*map(np.concatenate, zip(*found, strict=True)))[:2]
        new = seen[np.minimum(np.searchsorted(seen, codes), len(seen) - 1)] != codes
        levels.append((at, paths, kept, new))
        at, paths = codes[new], p[new]
        seen = np.sort(np.concatenate([seen, at]))
    nodes, deltas = [], []
    ahead = share = None  # of the level after
    for depth in range(len(levels) - 1, -1, -1):
        at, paths, kept, new = levels[depth]
        delta = np.zeros(len(at))
        if ahead is not None and len(ahead):
            if kept is not None:
                of = np.zeros(kept[2])
                of[new] = share
                delta += np.bincount(kept[0], of[kept[1]], minlength=len(at))
            else:
                for owner, step in _pieces(first, to, n, at):
                    place = np.minimum(np.searchsorted(ahead, step), len(ahead) - 1)
                    delta += np.bincount(owner, np.where(ahead[place] == step, share[place], 0.0), minlength=len(at))
            delta *= paths
        if depth:
            some = delta > 0
            nodes.append(at[some] % n)
            deltas.append(delta[some])
        ahead, share = at, (1 + delta) / paths
    return np.concatenate(nodes) if nodes else np.zeros(0, np.int64), np.concatenate(deltas) if deltas else np.zeros(0), steps


def sums(graph: WholeGraph, starts: DataFrame, scale: float = 1.0) -> DataFrame:
    """(id, s1, s2): over the sources starts (id), the sums of each node's shares times scale and of their squares, of nodes that have any."""
    folder = graph.folder
    spark = starts.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        if not t:
            return
        hashes, first, to = _read(f"{folder}/hashes", "<i8"), _read(f"{folder}/first", "<i8"), _read(f"{folder}/to", "<i4")
        n = len(hashes)
        mine = np.searchsorted(hashes, np.unique(t["h"]))
        mine = mine[first[mine + 1] > first[mine]]
        s1, s2 = np.zeros(n), np.zeros(n)
        low, width = 0, 16
        while low < len(mine):
            batch = mine[low : low + width]
            node, delta, steps = shares(first, to, n, batch)
            np.add.at(s1, node, delta * scale)
            np.add.at(s2, node, (delta * scale) ** 2)
            low += len(batch)
            width = int(min(4 * width, max(1, len(batch) * STEPS // max(1, 2 * steps)), 4096))
        some = np.flatnonzero(s1)
        yield pa.RecordBatch.from_arrays([pa.array(hashes[some]), pa.array(s1[some]), pa.array(s2[some])], ["h", "s1", "s2"])

    tasks = 2 * spark.sparkContext.defaultParallelism
    dealt = starts.select(F.xxhash64("id").alias("h")).repartition(tasks, "h")
    found = dealt.mapInArrow(run, "h long, s1 double, s2 double").groupBy("h").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    return graph.names.join(found, "h").select("id", "s1", "s2")
