"""Operator 1: near-duplicate documents by one-permutation MinHash.

Signature: one permutation of the shingle hashes cut into equal bins; the
least value of each bin, an empty bin taking that of the first full bin in an
order drawn for it alone (optimal densification). Bins are banded into bucket
keys. Each bucket proposes a star, from the member with the most company to
all others, so a bucket of n members gives n-1 pairs. Pairs are confirmed on
full shingle sets. Members of a bucket that the star left apart are then
compared inside the bucket, block by block, and only the links that join them
come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.functions.scratch import materialize
from topograph.llm.text import byte_column, mix, randoms, shingle_sets
from topograph.operators.components import connected_components

BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
_EDGES = np.array([(i << 64) // BINS for i in range(BINS)], np.uint64)
_DONORS = np.argsort(randoms(BINS * BINS, 11).reshape(BINS, BINS), axis=1)
_FACTOR = randoms(BINS, 12) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a sorted, non-empty set."""
    at = np.searchsorted(shingles, _EDGES)
    full = at < np.append(at[1:], len(shingles))
    out = shingles[np.minimum(at, len(shingles) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _DONORS[empty]
        out[empty] = out[order[np.arange(len(empty)), full[order].argmax(1)]]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    return mix((sig * _FACTOR).reshape(BANDS, ROWS).sum(1) + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


_SKETCH = "id long, n_shingles long, set_key string, bands array<long>"


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """Rows (id, n_shingles, set_key, bands) of (id, text); set_key names the full set, bands are its bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column("text"))
            n, keys, bands = [], [], []
            for s in shingle_sets(data, offsets, k):
                n.append(len(s))
                keys.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(signature(s)) if len(s) else np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(keys, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["id", "n_shingles", "set_key", "bands"],
            )

    return docs.select("id", "text").mapInArrow(run, _SKETCH)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """Rows (set_key, shingles) of (text), in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column("text"))
            sets, size = [], 0
            for i, s in enumerate(shingle_sets(data, offsets, k)):
                sets.append(s)
                size += len(s)
                if size > 1 << 18 or i == batch.num_rows - 1:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                    keys = pa.array([xxhash.xxh3_128_hexdigest(x.tobytes()) for x in sets])
                    yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["set_key", "shingles"])
                    sets, size = [], 0

    return docs.select("text").mapInArrow(run, "set_key string, shingles array<long>")


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def block_links(ids: np.ndarray, sets: list[np.ndarray], groups: np.ndarray, sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join groups of one bucket's members, at most one for each two groups that meet.

    Only members on side 0 are compared, to all members of other groups, by
    counting common shingles through an inverted index; groups that a link has
    joined are not compared again.
    """
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    group = groups.copy()
    out = []
    for i in np.flatnonzero(sides == 0):
        if (group == group[i]).all():
            continue
        lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        n = hi - lo
        seen = owner[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        inter = np.bincount(seen, minlength=len(sets))
        for j in np.flatnonzero(linked(inter, size[i], size, percent)):
            if group[j] != group[i]:
                out.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]
    return out


def _finish_buckets(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between members of one bucket that the stars did not bring together.

    members (bucket, cls), labels (cls, comp). Buckets of one component need
    nothing. In the others the members outside the largest component are
    compared to all members; a bucket over block members is cut into pairs of
    blocks, so no task holds more than two blocks at once.
    """
    m = members.join(labels, "cls", "left").select("bucket", "cls", F.coalesce("comp", "cls").alias("comp"))
    m = materialize(m, "members")
    by_comp = m.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    open_ = by_comp.groupBy("bucket").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp"))["comp"].alias("main")).where("comps > 1 and size > 2")
    m = m.join(open_, "bucket").select("bucket", "cls", "comp", "size", (F.col("comp") != F.col("main")).alias("apart"))
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    # side 0 rows go along a row of blocks, all rows down a column of blocks
    m = m.withColumn("blocks", blocks).withColumn("mine", mine)
    every = F.expr("explode(sequence(0, blocks - 1))")
    down = m.select("bucket", "cls", "comp", every.alias("i"), F.col("mine").alias("j"), F.lit(1).alias("side"))
    along = m.where("apart").select("bucket", "cls", "comp", F.col("mine").alias("i"), every.alias("j"), F.lit(0).alias("side"))
    rows = down.union(along).groupBy("bucket", "i", "j", "cls", "comp").agg(F.min("side").alias("side")).join(sets, "cls")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        if (pdf["side"] == 0).any() and pdf["comp"].nunique() > 1:
            pdf = pdf.sort_values("cls")
            found = block_links(pdf["cls"].to_numpy(), [np.asarray(s, np.int64) for s in pdf["shingles"]], pdf["comp"].to_numpy(), pdf["side"].to_numpy(), percent)
        return pd.DataFrame(found, columns=["src", "dst"]).astype("int64")

    return rows.groupBy("bucket", "i", "j").applyInPandas(run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 80, block: int = 2048) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their
    sets of k-word shingles. Documents with equal sets are one class from the
    start. A null or wordless text has no shingles and no link; a row whose id
    is null takes no part and gets a null component_id and kept = false. Rows
    that repeat an id each get a row, judged by their own text. An empty table
    gives no rows; texts of any length are read whole, one at a time beyond
    1 MB. Other columns of docs play no part.
    """
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sk = materialize(sketches(given, k), "sketch")
    least = F.min_by(F.struct("id", "bands"), "id").alias("x")
    classes = sk.where("set_key is not null and id is not null").groupBy("set_key").agg(least).select("set_key", "x.id", F.col("x.id").alias("cls"), "x.bands")
    classes = materialize(classes, "classes")
    shared = classes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not shared.isEmpty():
        # an id that stands before different texts can't name their classes
        named = classes.join(shared, "id", "left")
        classes = materialize(named.withColumn("cls", F.when(F.col("n") > 1, F.xxhash64("set_key")).otherwise(F.col("id"))).drop("n"), "classes")

    banded = classes.select("cls", F.explode("bands").alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(banded.join(full, "bucket"), "buckets")
    # the more company a class has over its buckets, the better a hub it is
    worth = members.groupBy("cls").agg(F.sum("n").alias("worth"))
    ranked = members.join(worth, "cls").select("bucket", F.struct("worth", (-F.col("cls")).alias("low")).alias("rank"))
    hubs = ranked.groupBy("bucket").agg((-F.max("rank")["low"]).alias("hub"))
    pairs = materialize(members.join(hubs, "bucket").where("hub <> cls").select("hub", "cls").distinct(), "pairs")

    wanted = members.select("cls").distinct().join(classes.select("cls", "id", "set_key"), "cls")
    texts = given.join(wanted.select("id"), "id", "left_semi")
    sets = materialize(full_sets(texts, k).join(wanted.select("set_key", "cls"), "set_key").select("cls", "shingles"), "sets")
    inter = F.size(F.array_intersect("shingles", "other"))
    stars = pairs.join(sets, "cls").join(sets.select(F.col("cls").alias("hub"), F.col("shingles").alias("other")), "hub")
    links = stars.where(100 * inter >= percent * (F.size("shingles") + F.size("other") - inter))
    links = materialize(links.select(F.col("hub").alias("src"), F.col("cls").alias("dst")), "links")
    labels = _labels(links)

    crowded = members.where("n > 2").select("bucket", "cls")
    more = materialize(_finish_buckets(crowded, labels, sets, percent, block), "more")
    if not more.isEmpty():
        labels = _labels(links.union(more))
    found = classes.select("set_key", "id", "cls").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = found.groupBy("comp").agg(F.min("id").alias("component_id"))
    out = sk.drop("bands").join(found.join(least, "comp").select("set_key", "component_id"), "set_key", "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"),
    )


def _labels(links: DataFrame) -> DataFrame:
    return connected_components(links).select(F.col("id").alias("cls"), F.col("component").alias("comp"))
