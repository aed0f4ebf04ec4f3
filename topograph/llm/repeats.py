"""Operator 10: removal of long repeated byte strings by bucket-pointer refinement of suffix buckets.

Two texts share a string of LENGTH bytes only if they share the anchor in it:
the Q-gram of least rank among the Q-grams of the string. So
1. the anchors of all texts form the initial q-gram buckets, and those with
   one member are done;
2. each remaining anchor carries the bytes of the strings it stands for;
   members of one anchor bucket meet in one task, in order of their suffixes;
3. there the suffixes of these bytes are sorted into buckets by their first
   GRAM bytes, and a suffix points at its bucket. Each bucket of several is
   then sorted on the pointers of the suffixes that follow its members, and the
   new pointers are used at once by the buckets that come after; the offset
   grows with the depth reached, up to LENGTH.
Neighbours in the order that this gives are compared byte by byte; a string is
repeated if an equal one among its neighbours starts earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.functions.scratch import materialize
from topograph.llm.text import byte_column, mix, randoms

LENGTH, Q, GRAM = 100, 32, 8
#: Buckets are refined in so many turns at each offset; every turn sees the pointers of those before.
SLICES = 4
#: Members of an anchor bucket that one task may hold; larger buckets are refined by shuffled keys.
HOT = 100_000

_TABLE = randoms(256, 21) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPAN = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.full(_SPAN + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the n-byte strings at every start, by differences of prefix sums."""
    out = np.empty(max(0, len(data) - n + 1), np.uint64)
    step = _SPAN - n
    for a in range(0, len(out), step):
        part = data[a : a + _SPAN - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[part] * _UP[: len(part)], out=sums[1:])
        k = min(step, len(out) - a, len(part) - n + 1)
        out[a : a + k] = (sums[n : n + k] - sums[:k]) * _DOWN[:k]
    return out


def anchors(data: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, key, first, last): the anchors of a text, each with the starts first..last of the strings it stands for.

    Of equal least Q-grams in a string the last one is its anchor.
    """
    parts = []
    w = length - q + 1
    low = np.uint64(_SPAN - 1)
    for a in range(0, max(0, len(data) - length + 1), _SPAN // 2):
        part = data[a : a + _SPAN // 2 + length - 1]
        rank = mix(grams(part, q))
        n = len(rank) - w + 1
        # the low bits hold the place, so that a minimum tells where it is
        value = (rank & ~low) | (low - np.arange(len(rank), dtype=np.uint64))
        blocks = -(-len(rank) // w)
        padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(rank)] = value
        grid = padded.reshape(blocks, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.append(first[1:], n) - 1
        place = (low - (least[first] & low)).astype(np.int64)
        parts.append((place + a, rank[place].view(np.int64), first + a, last + a))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(key, did, spot, n) of (did, text); spot packs the place and how far the strings reach before it.

    Keys that come again within some ten thousand anchors are summed up here:
    one row stands for n of them, the others have n = 0 and need no partner.
    """

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        key, did, spot = (np.concatenate(x) for x in zip(*rows, strict=True))
        _, first, back, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        n = np.where(first[back] == np.arange(len(key)), count[back], 0)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, did, spot, n)], ["key", "did", "spot", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column("text"))
            dids = batch.column("did").to_numpy(zero_copy_only=False)
            rows, size = [], 0
            for i, did in enumerate(dids.tolist()):
                place, key, first, last = anchors(data[offsets[i] : offsets[i + 1]])
                rows.append((key, np.full(len(key), did, np.int64), (place << 16) | ((place - first) << 8) | (last - first)))
                size += len(key)
                if size > 1 << 16 or i == len(dids) - 1:
                    yield pack(rows)
                    rows, size = [], 0

    return docs.mapInArrow(run, "key long, did long, spot long, n long")


def _crowded(rows: DataFrame, parts: int, hot: int) -> DataFrame:
    """(key, did, spot) of the anchors whose key another one shares; a null did names a key of more than hot anchors.

    Rows stream by in order of their keys, so a key of any size takes no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, the number of its key and whether that has company
        held_key = count = 0
        kept = False
        names = ["key", "did", "spot"]
        for batch in batches:
            n = batch.column("n").to_numpy()
            if (n == 0).any():
                yield batch.filter(pa.array(n == 0)).select(names)
                batch = batch.filter(pa.array(n > 0))
                n = n[n > 0]
            if not len(n):
                continue
            key = batch.column("key").to_numpy()
            same = key[1:] == key[:-1]
            joins = held is not None and held_key == key[0]
            if held is not None and (kept or joins):
                yield held
            keep = n > 1
            keep[0] |= joins
            keep[1:] |= same
            keep[:-1] |= same
            rest = batch.slice(0, len(n) - 1).filter(pa.array(keep[:-1]))
            if rest.num_rows:
                yield rest.select(names)
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            total = np.add.reduceat(n, starts)
            before = count if joins else 0
            total[0] += before
            large = (total > hot) & ~((np.arange(len(total)) == 0) & (before > hot))
            if large.any():
                none = pa.nulls(int(large.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key[starts[large]]), none, none], names)
            held, held_key, count, kept = batch.slice(len(n) - 1).select(names), key[-1], int(total[-1]), bool(keep[-1])
        if held is not None and kept:
            yield held

    by = F.when(F.col("n") == 0, F.col("did")).otherwise(F.col("key"))
    return rows.repartition(parts, by).sortWithinPartitions("key").mapInArrow(run, "key long, did long, spot long")


def _contexts(marked: DataFrame) -> DataFrame:
    """(key, did, start, end, bytes): for each anchor the bytes of all strings it stands for; of (did, text, keys, spots).

    Of equal bytes within some ten thousand anchors only the earliest has to
    meet others; the later ones are repeated throughout and have null bytes.
    """

    def pack(key: list, did: list, start: list, data: list[bytes]) -> pa.RecordBatch:
        key, did, start = np.concatenate(key), np.concatenate(did), np.concatenate(start)
        order = np.lexsort((start, did))
        key, did, start = key[order], did[order], start[order]
        seen: set[bytes] = set()
        size, rest = [], []
        for i in order.tolist():
            x = data[i]
            size.append(len(x))
            rest.append(None if x in seen else x)
            seen.add(x)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(did), pa.array(start), pa.array(start + np.array(size)), pa.array(rest, pa.binary())], ["key", "did", "start", "end", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], [], [], []), 0
        for batch in batches:
            data, offsets = byte_column(batch.column("text"))
            for i, (did, keys, spots) in enumerate(zip(batch.column("did").to_pylist(), batch.column("keys"), batch.column("spots"), strict=True)):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                spot = spots.values.to_numpy()
                first = (spot >> 16) - ((spot >> 8) & 255)
                stop = first + (spot & 255) + LENGTH
                held[0].append(keys.values.to_numpy())
                held[1].append(np.full(len(spot), did, np.int64))
                held[2].append(first)
                held[3].extend(text[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True))
                size += len(spot)
                if size > 1 << 16:
                    yield pack(*held)
                    held, size = ([], [], [], []), 0
        if size:
            yield pack(*held)

    return marked.mapInArrow(run, "key long, did long, start long, end long, bytes binary")


def _packed(data: np.ndarray) -> np.ndarray:
    """The GRAM bytes from each place on as one number, as if zeros came after the end."""
    out = np.concatenate([data, np.zeros(GRAM, np.uint8)]).astype(np.uint64)
    for n in (1, 2, 4):
        out[:-n] = out[:-n] << np.uint64(8 * n) | out[n:]
    return out[: len(data)]


def suffix_order(data: np.ndarray, grams: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All suffixes of data, sorted by their first bytes, depth of them at least, by bucket-pointer refinement."""
    n = len(data)
    order = np.argsort(grams)
    value = grams[order]
    last = np.append(np.flatnonzero(value[1:] != value[:-1]), n - 1)
    size = np.diff(last, prepend=-1)
    #: the place behind the last member of a suffix's bucket; 0 after the end of data
    pointer = np.zeros(n + 2 * depth, np.int64)
    pointer[order] = np.repeat(last + 1, size)
    known = GRAM
    while known < depth:
        several = np.flatnonzero(np.repeat(size > 1, size))  # suffixes alone in a bucket leave
        if not len(several):
            break
        bucket = pointer[order[several]]
        cuts = np.unique(np.searchsorted(bucket, bucket[np.arange(1, SLICES) * len(several) // SLICES]))
        for at in np.split(several, cuts):
            if not len(at):
                continue
            members = order[at]
            key = pointer[members] << 32 | pointer[members + known]
            by = np.argsort(key)
            members, key = members[by], key[by]
            order[at] = members
            end = np.append(np.flatnonzero(key[1:] != key[:-1]), len(key) - 1)
            pointer[members] = np.repeat(at[end] + 1, np.diff(end, prepend=-1))
        value = pointer[order]
        last = np.append(np.flatnonzero(value[1:] != value[:-1]), n - 1)
        size = np.diff(last, prepend=-1)
        known *= 2
    return order


def refine(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shift) of the strings that an earlier row, or an earlier string of the row, has too.

    Rows are the bytes around anchors, in order of document and start.
    """
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = np.diff(offsets) - (LENGTH - 1)
    row = np.repeat(np.arange(len(n)), n)
    shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    number = np.full(len(data), -1, np.int64)
    number[offsets[:-1][row] + shift] = np.arange(len(row))
    grams = _packed(data)
    order = suffix_order(data, grams)
    order = order[number[order] >= 0]
    same = np.flatnonzero(grams[order[1:]] == grams[order[:-1]]) + 1
    for ahead in [*range(GRAM, LENGTH - GRAM, GRAM), LENGTH - GRAM]:
        same = same[grams[order[same] + ahead] == grams[order[same - 1] + ahead]]
    equal = np.zeros(len(order) + 1, bool)
    equal[same] = True
    first = np.flatnonzero(~equal[:-1])
    # of equal strings the earliest stays
    least = np.repeat(np.minimum.reduceat(order, first), np.diff(first, append=len(order))) if len(order) else order
    found = np.sort(number[order[order != least]])
    return row[found], shift[found]


def _runs(did: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(did, start, end) of the bytes covered by strings that start at the given places, in order."""
    new = np.concatenate([[True], (did[1:] != did[:-1]) | (start[1:] != start[:-1] + 1)]) if len(did) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(did)) - 1
    return did[at], start[at], start[end[: len(at)]] + LENGTH


def _repeated(contexts: DataFrame, parts: int) -> DataFrame:
    """(did, start, end) of repeated bytes; all rows of a key are refined together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(batches).combine_chunks()
            # of equal bytes under one key only the earliest is refined
            seen: set[bytes] = set()
            again, last = np.zeros(len(t), bool), None
            for i, (k, x) in enumerate(zip(t.column("key").to_pylist(), t.column("bytes").to_pylist(), strict=True)):
                if k != last:
                    seen.clear()
                    last = k
                again[i] = x in seen
                seen.add(x)
            if again.any():
                yield from t.filter(pa.array(again)).select(["did", "start", "end"]).to_batches()
                t = t.filter(pa.array(~again))
            # equal strings have their anchor at the same place, so a row never meets itself
            key = t.column("key").to_numpy()
            several = np.zeros(len(key) + 1, bool)
            several[1:-1] = key[1:] == key[:-1]
            t = t.filter(pa.array(several[1:] | several[:-1])).combine_chunks()
            if not len(t):
                return
            key, did, start = (t.column(c).to_numpy() for c in ("key", "did", "start"))
            data, offsets = byte_column(t.column("bytes").combine_chunks())
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = offsets[cuts]
            a = 0
            while a < len(cuts):  # some thousand rows at a time, whole keys
                b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + (1 << 20))))
                lo, hi = cuts[a], cuts[b] if b < len(cuts) else len(key)
                row, shift = refine(data, offsets[lo : hi + 1])
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _runs(did[lo + row], start[lo + row] + shift)], ["did", "start", "end"])
                a = b

        for batch in batches:
            told = batch.column("bytes").is_valid()
            if told.false_count:
                yield batch.filter(pc.invert(told)).select(["did", "start", "end"])
                batch = batch.filter(told)
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # where the last key, which may go on, begins
            if cut or (held and held[-1].column("key")[0].as_py() != key[-1]):
                yield from done([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from done(held)

    by = F.when(F.col("bytes").isNull(), F.col("did")).otherwise(F.col("key"))
    return contexts.repartition(parts, by).sortWithinPartitions("key", "did", "start").mapInArrow(run, "did long, start long, end long")


def _repeated_hot(contexts: DataFrame) -> DataFrame:
    """The same for keys of very many rows: equal strings meet by a shuffle, summed up before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column("bytes"))
            for i, (did, start) in enumerate(zip(batch.column("did").to_pylist(), batch.column("start").to_pylist(), strict=True)):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                n = len(text) - LENGTH + 1
                yield pa.RecordBatch.from_arrays([pa.array([text[k : k + LENGTH] for k in range(n)], pa.binary()), pa.array(np.full(n, did, np.int64)), pa.array(np.arange(start, start + n))], ["string", "did", "start"])

    rows = materialize(contexts.mapInArrow(run, "string binary, did long, start long"), "hot")
    earliest = rows.groupBy("string").agg(F.min(F.struct("did", "start")).alias("least"))
    later = rows.join(earliest, "string").where(F.struct("did", "start") > F.col("least"))
    return later.select("did", "start", (F.col("start") + LENGTH).alias("end"))


def _merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_CUT = "did long, spans array<struct<start:long,end:long>>, n_removed long, kept_sha256 string"


def _cut(marked: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column("text"))
            rows = ([], [], [])
            for i, spans in enumerate(zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                merged = _merge(list(zip(*spans, strict=True)))
                left = without(text, merged)
                rows[0].append([{"start": a, "end": b} for a, b in merged])
                rows[1].append(len(text) - len(left))
                rows[2].append(hashlib.sha256(left).hexdigest())
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(rows[0], spans_type), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], ["did", "spans", "n_removed", "kept_sha256"])

    return marked.mapInArrow(run, _CUT)


def without(text: bytes, spans: list) -> bytes:
    """text without the bytes of sorted, disjoint spans."""
    return b"".join(text[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)], strict=True))


def kept_texts(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes of remove_repeats taken out of text_col; a character that a cut splits goes too.

    Rows are told apart by id and the digest of their text.
    """
    names = docs.columns
    cuts = found.where("n_removed > 0").select(F.col(id_col).alias("id"), "sha", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends")).dropDuplicates(["id", "sha"])
    # the columns of docs travel in one, so that none can clash
    packed = docs.select(F.struct(*names).alias("row"), F.col(id_col).cast("long").alias("id"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("sha"))
    joined = packed.join(cuts, ["id", "sha"], "left").select("row", "starts", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.column("row").flatten(), strict=True))
            texts = columns[text_col].to_pylist()
            for i, (starts, ends) in enumerate(zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)):
                if starts:
                    texts[i] = without(texts[i].encode(), list(zip(starts, ends, strict=True))).decode("utf-8", "ignore")
            columns[text_col] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return joined.mapInArrow(run, docs.schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row; with keep_text, also kept.

    A byte goes if a string of LENGTH bytes over it also starts earlier: in a
    document of a smaller id, or before in its own; kept_texts() takes them
    out. A null text counts as empty. A row whose id is null takes no part and
    keeps its text. Rows that repeat id and text are one document and get the
    same result; rows that repeat an id with another text are documents in the
    order of their texts' digests. An empty table gives no rows; texts of any
    length are read in segments. Other columns play no part.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    base = given.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    base = materialize(base, "texts")
    given = given.where("id is not null")
    twice = base.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    if twice.isEmpty():
        base = base.withColumn("did", F.col("id"))
        given = given.select(F.col("id").alias("did"), "text")
    else:
        # documents are numbered in the order of (id, sha): partitions by range, sorted, and numbers that grow with both
        one = base.where("id is not null").select("id", "sha").distinct()
        turns = materialize(one.repartitionByRange("id", "sha").sortWithinPartitions("id", "sha").withColumn("did", F.monotonically_increasing_id()), "turns")
        base = materialize(base.join(turns, ["id", "sha"], "left").select("id", "n_bytes", "sha", "did"), "texts")
        given = given.withColumn("sha", F.sha2("text", 256)).join(turns, ["id", "sha"]).select("did", "text")
        given = materialize(given.dropDuplicates(["did"]), "given")  # else a repeated row would meet itself

    reps = base.where(f"id is not null and n_bytes >= {LENGTH}").groupBy("sha").agg(F.min("did").alias("rep"))
    reps = materialize(reps, "reps")  # so that a join may split the rows of one text
    anchored = materialize(_crowded(_anchor_rows(given), parts, hot), "anchors")
    large = anchored.where("did is null").select("key").distinct()
    per_doc = anchored.where("did is not null").join(reps.select(F.col("rep").alias("did")), "did", "left_semi").distinct()
    per_doc = per_doc.groupBy("did").agg(F.collect_list(F.struct("key", "spot")).alias("x")).select("did", F.col("x.key").alias("keys"), F.col("x.spot").alias("spots"))
    contexts = _contexts(given.join(per_doc, "did").select("did", "text", "keys", "spots"))
    if large.isEmpty():
        found = _repeated(contexts, parts)
    else:
        # there are at most rows / hot such keys
        contexts = materialize(contexts, "contexts")
        found = _repeated(contexts.where("bytes is not null").join(large, "key", "left_anti").union(contexts.where("bytes is null")), parts).union(_repeated_hot(contexts.where("bytes is not null").join(large, "key", "left_semi")))
    spans = found.groupBy("did").agg(F.collect_list(F.struct("start", "end")).alias("x")).select("did", F.col("x.start").alias("starts"), F.col("x.end").alias("ends"))
    cut = _cut(given.join(spans, "did").select("did", "text", "starts", "ends"))
    cut = materialize(cut.dropDuplicates(["did"]), "cut")

    copy = F.coalesce(F.col("rep") < F.col("did"), F.lit(False))
    out = base.join(reps, "sha", "left").join(cut, "did", "left").select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce(F.size("spans"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))).alias("spans"),
        "sha",
    )
    if not keep_text:
        return out
    whole = docs.select(F.col(id_col).cast("long").alias(id_col), text.alias("kept"), F.sha2(text, 256).alias("_of")).distinct()
    left = kept_texts(whole, out, id_col, "kept").withColumnRenamed(id_col, "_left")
    return out.join(left, F.col(id_col).eqNullSafe(F.col("_left")) & (F.col("sha") == F.col("_of")), "left").drop("_left", "_of")
