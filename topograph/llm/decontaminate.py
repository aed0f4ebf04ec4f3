"""Operator 7: benchmark decontamination by greedy string tiling.

Texts are runs of tokens: letters and digits, lower-cased, any other ASCII
character parts them. Documents and items are joined on their seeds, the runs of
SEED tokens; a bitmap of the items' seeds, of bounded size, keeps seeds that no
item has out of that join. A pair stays a candidate if the seeds it shares could
cover enough of the item. For each such pair the longest common run of unmarked
tokens is marked as a tile, again and again, until none of SEED tokens is left;
so a passage whose sentences were put in another order is still covered. Runs
meet by running Karp-Rabin fingerprints and are confirmed token by token. An
item is leaked if its tiles cover at least a given share of its tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.functions.scratch import materialize
from topograph.llm.text import GOLDEN, MARKS, byte_column, chunks, mix, shingles, words

SEED = 5
#: Bits of the map for each seed of an item, and the most bits of all: 16 MB.
BITS_EACH, BITS_MOST = 64, 27
#: Bits of the map that one group sets.
_PART = 16
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BASE = 0x9E3779B97F4A7C15


def _fingerprints(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums up to each place, and the factors that move a difference of two to the front."""
    n = len(tokens)
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix((tokens.astype(np.uint64) + np.uint64(1)) * GOLDEN) * up[:n], out=sums[1:])
    return sums, down


def _free(marked: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many unmarked tokens there are from each place on."""
    stops = np.append(np.flatnonzero(marked), len(marked))
    return stops[np.searchsorted(stops, places)] - places


def tiles(doc: np.ndarray, item: np.ndarray, seed: int = SEED) -> list[tuple[int, int, int]]:
    """(place in doc, place in item, length) of greedy string tiling; both are arrays of token numbers.

    The longest length at which unmarked runs meet is searched for by halving;
    then all runs of that length are marked, the first in doc, then in item,
    first. Memory is in proportion to the two, however often they repeat
    themselves.
    """
    seed = min(seed, len(item))
    if not seed or len(doc) < seed:
        return []
    ours, theirs = _fingerprints(doc), _fingerprints(item)

    def prints(of: tuple[np.ndarray, np.ndarray], places: np.ndarray, k: int) -> np.ndarray:
        return (of[0][places + k] - of[0][places]) * of[1][places]

    used, covered = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    doc_at, item_at = np.arange(len(doc) - seed + 1), np.arange(len(item) - seed + 1)
    a, b = prints(ours, doc_at, seed), prints(theirs, item_at, seed)
    doc_at, item_at = doc_at[np.isin(a, b)], item_at[np.isin(b, a)]  # longer runs begin at such places only
    out: list[tuple[int, int, int]] = []
    high = min(len(doc), len(item))
    while high >= seed and len(doc_at) and len(item_at):
        doc_free, item_free = _free(used, doc_at), _free(covered, item_at)
        keep = doc_free >= seed
        doc_at, doc_free = doc_at[keep], doc_free[keep]
        keep = item_free >= seed
        item_at, item_free = item_at[keep], item_free[keep]
        if not len(doc_at) or not len(item_at):
            break
        low, high = seed - 1, min(high, int(doc_free.max()), int(item_free.max()))
        while low < high:
            k = (low + high + 1) // 2
            if np.isin(prints(ours, doc_at[doc_free >= k], k), prints(theirs, item_at[item_free >= k], k)).any():
                low = k
            else:
                high = k - 1
        k = low
        if k < seed:
            break
        mine, other = doc_at[doc_free >= k], item_at[item_free >= k]
        waiting: dict[int, list[int]] = {}
        for j, value in zip(other[::-1].tolist(), prints(theirs, other[::-1], k).tolist(), strict=True):
            waiting.setdefault(value, []).append(j)
        busy = -1
        for i, value in zip(mine.tolist(), prints(ours, mine, k).tolist(), strict=True):
            there = waiting.get(value)
            if i < busy or not there:
                continue
            while there and covered[there[-1] : there[-1] + k].any():
                there.pop()
            for at in range(len(there) - 1, -1, -1):
                j = there[at]
                if not covered[j : j + k].any() and np.array_equal(doc[i : i + k], item[j : j + k]):
                    used[i : i + k] = covered[j : j + k] = True
                    out.append((i, j, k))
                    busy = i + k
                    break
        high = k - 1
    return out


def _tokens(column: pa.Array) -> Iterator[np.ndarray]:
    """The hashed tokens of each text."""
    data, offsets = byte_column(pc.utf8_lower(column.fill_null("")))
    for a, b in chunks(offsets):
        hashes, rows = words(data, offsets[a : b + 1], MARKS)
        for i in range(b - a):
            yield hashes[rows[i] : rows[i + 1]]


def _item_seeds(items: DataFrame, seed: int) -> DataFrame:
    """(seed, item, sha, n, k, times): how often each run of k tokens comes in an item of n; k is seed, or n if that is less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, tokens in enumerate(_tokens(batch.column("item_text"))):
                if not len(tokens):
                    continue
                k = min(seed, len(tokens))
                values, times = np.unique(shingles(tokens, k), return_counts=True)
                m = len(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.view(np.int64)), pa.array(np.full(m, batch.column("item")[i].as_py())), pa.array([batch.column("sha")[i].as_py()] * m, pa.string()), pa.array(np.full(m, len(tokens))), pa.array(np.full(m, k)), pa.array(times)],
                    ["seed", "item", "sha", "n", "k", "times"],
                )

    return items.select("item", "sha", "item_text").mapInArrow(run, "seed long, item long, sha string, n long, k long, times long")


def _seed_map(seeds: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, map): a bit for each value that the first bits of seeds may take; at most 2^BITS_MOST of them."""
    count = seeds.count()
    bits = min(BITS_MOST, max(_PART, (count * BITS_EACH).bit_length()))
    place = F.shiftrightunsigned("seed", 64 - bits)
    parts = seeds.select(F.shiftright(place, _PART).alias("part"), place.bitwiseAND(F.lit((1 << _PART) - 1)).alias("at")).distinct()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << _PART, bool)
        flags[pdf["at"].to_numpy()] = True
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "flags": [np.packbits(flags, bitorder="little").tobytes()]})

    out = np.zeros(1 << bits - 3, np.uint8)
    size = 1 << _PART - 3
    for row in parts.groupBy("part").applyInPandas(pack, "part long, flags binary").toLocalIterator():
        out[row.part * size : (row.part + 1) * size] = np.frombuffer(row.flags, np.uint8)
    return bits, out


def _doc_seeds(docs: DataFrame, bits: int, flags: np.ndarray, sizes: list[int]) -> DataFrame:
    """(id, seed) of the distinct runs of tokens of each text that the map doesn't rule out."""
    shared = docs.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = shared.value
        for batch in batches:
            ids, seeds = [], []
            for i, tokens in enumerate(_tokens(batch.column("text"))):
                for k in sizes:
                    if len(tokens) < k:
                        continue
                    values = shingles(tokens, k)
                    place = values >> np.uint64(64 - bits)
                    found = values[(flags[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0]
                    if len(found):
                        found = np.unique(found)
                        seeds.append(found.view(np.int64))
                        ids.append(np.full(len(found), batch.column("id")[i].as_py(), np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(seeds))], ["id", "seed"])

    return docs.mapInArrow(run, "id long, seed long")


def _tile(pairs: DataFrame, seed: int, share: float) -> DataFrame:
    """(id, item, coverage, n_tiles, longest) of the pairs (id, item, text, item_text) whose tiles cover enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            docs, items = (pc.utf8_lower(batch.column(c)) for c in ("text", "item_text"))
            held, numbers, doc = None, {}, np.zeros(0, np.int64)
            for i, (id_, item) in enumerate(zip(batch.column("id").to_pylist(), batch.column("item").to_pylist(), strict=True)):
                text = docs[i].as_py().encode()
                if text != held:
                    held, numbers = text, {}
                    doc = np.array([numbers.setdefault(t, len(numbers)) for t in _TOKEN.findall(text)], np.int64)
                # tokens that the document lacks get numbers of their own
                other = np.array([numbers.get(t, -1 - j) for j, t in enumerate(_TOKEN.findall(items[i].as_py().encode()))], np.int64)
                sizes = [k for _, _, k in tiles(doc, other, seed)]
                if sizes and sum(sizes) >= share * len(other):
                    found.append((id_, item, sum(sizes) / len(other), len(sizes), max(sizes)))
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["id", "item", "coverage", "n_tiles", "longest"])

    return pairs.select("id", "item", "text", "item_text").mapInArrow(run, "id long, item long, coverage double, n_tiles long, longest long")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = SEED, share: float = 0.5) -> DataFrame:
    """(id_col, item_col, coverage, n_tiles, longest) of every document and item that it leaks.

    coverage is the share of the item's tokens under tiles, at least share.
    Items of fewer tokens than a seed are one seed. Null or tokenless texts and
    items leak nothing; a null id, on either side, is left out. Rows that
    repeat an id give one row for each item, with the greatest coverage; equal
    items under several ids are judged each. Empty tables, on either side, give
    none. A long or periodic text takes time and memory in proportion to
    itself. Other columns play no part; the benchmark's may be named like those
    of docs.
    """
    given = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("item_text")).where("item is not null and item_text is not null").distinct()
    items = items.withColumn("sha", F.sha2("item_text", 256))
    seeds = materialize(_item_seeds(items, seed), "seeds")
    sizes = sorted(r.k for r in seeds.select("k").distinct().collect())  # at most seed of them
    bits, flags = _seed_map(seeds.select("seed"))
    met = _doc_seeds(given, bits, flags, sizes).join(seeds, "seed")
    pairs = met.groupBy("id", "item", "sha").agg((F.sum("times") * F.first("k")).alias("most"), F.first("n").alias("n")).where(F.col("most") >= share * F.col("n"))
    pairs = materialize(pairs.select("id", "item", "sha"), "candidates")
    texts = given.join(pairs, "id").join(items, ["item", "sha"])
    best = _tile(texts, seed, share).groupBy("id", "item").agg(F.max(F.struct("coverage", "n_tiles", "longest")).alias("x"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "x.coverage", "x.n_tiles", "x.longest")
