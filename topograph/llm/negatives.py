"""Operator 13: hard negatives by rotated one-bit codes with stored alignments.

Every vector is turned by one random rotation (signs and Hadamard transforms)
and keeps the signs of its coordinates as a code x of D bits, its length, and
the alignment a: the inner product of it and its code vector. What the code
leaves of it is coded in the same way, LEVELS times in all, and the length of
the last rest is kept. With unit vectors o (a row) and q (an anchor),

    <o, q> = a1*<x1, q> + a2*<x2, q> + ... + <r, q>,   |<r, q>| <= |r|

by Cauchy and Schwarz, with no chance left to it. Each <x, q> comes from
popcounts of the code with the bit planes of q, whose rounding is bounded by its
length and added to the interval. A row goes on only if its interval can reach
what is asked for; those are scored by integers.

Rows and anchors are dealt into blocks by hash, and each pair of blocks is one
task's group of bounded size, which gives the few best of each anchor. So
neither a popular vector nor a common label makes a large group, and nothing
but the best travels on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topograph.functions.scratch import materialize
from topograph.llm.text import mix

#: Rows and anchors of a block, pairs that one numpy pass looks at.
ROWS, ANCHORS, PAIRS = 16384, 2048, 1 << 21
#: Bits to which an anchor's turned coordinates are rounded.
PLANES = 8
#: One-bit codes of a vector: in 64 dimensions one alone leaves a rest of 0.6, too much to rule out anything; four leave 0.1.
LEVELS = 4
#: Scores are held within this.
_MOST = (1 << 63) - 1
CODES = "rid long, vec_id long, label int, ints binary, code binary, norm double, align array<double>, rest double"


def turn(vectors: np.ndarray) -> np.ndarray:
    """Rows rotated: three times signs, then a Hadamard transform. Their number of columns is a power of two."""
    n, d = vectors.shape
    out = vectors.astype(np.float64)
    for i in range(3):
        out = out * np.where(mix(np.arange(d, dtype=np.uint64) + np.uint64(1000003 * (i + 1))) >> np.uint64(63), 1.0, -1.0)
        step = 1
        while step < d:
            out = out.reshape(n, d // (2 * step), 2, step)
            out = np.stack([out[:, :, 0] + out[:, :, 1], out[:, :, 0] - out[:, :, 1]], axis=2).reshape(n, d)
            step *= 2
        out /= np.sqrt(d)
    return out


def encode(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes as 64-bit words, one level after the other, lengths, alignments of each level, lengths of the rests) of integer vectors."""
    norm = np.sqrt((ints.astype(np.float64) ** 2).sum(1))
    rest = turn(ints / np.maximum(norm, 1)[:, None])
    d = rest.shape[1]
    words, align = [], np.empty((len(ints), LEVELS))
    for level in range(LEVELS):
        sign = rest >= 0
        align[:, level] = np.abs(rest).sum(1) / np.sqrt(d)
        words.append(np.packbits(sign, axis=1, bitorder="little").view(np.uint64))
        rest = rest - np.where(sign, 1.0, -1.0) * (align[:, level] / np.sqrt(d))[:, None]
    return np.concatenate(words, axis=1), norm, align, np.sqrt((rest**2).sum(1))


class Planes:
    """Anchors ready for popcounts."""

    def __init__(self, ints: np.ndarray):
        self.norm = np.sqrt((ints.astype(np.float64) ** 2).sum(1))
        unit = turn(ints / np.maximum(self.norm, 1)[:, None])
        self.d = unit.shape[1]
        self.low = unit.min(1)
        self.step = np.maximum((unit.max(1) - self.low) / ((1 << PLANES) - 1), 1e-12)
        levels = np.rint((unit - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.error = np.sqrt(((unit - self.low[:, None] - self.step[:, None] * levels) ** 2).sum(1))
        self.total = levels.sum(1)
        self.bits = [np.packbits(levels >> j & 1, axis=1, bitorder="little").view(np.uint64) for j in range(PLANES)]

    def intervals(self, codes: np.ndarray, norm: np.ndarray, align: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) bounds of the inner products, anchors by rows."""
        middle = np.zeros((len(self.norm), len(codes)))
        for level, code in enumerate(np.split(codes, LEVELS, axis=1)):
            ones = np.bitwise_count(code).astype(np.int64).sum(1)
            both = np.zeros(middle.shape, np.int64)
            for j, plane in enumerate(self.bits):
                for w in range(code.shape[1]):
                    both += np.bitwise_count(plane[:, w, None] & code[None, :, w]).astype(np.int64) << j
            # the sum over coordinates of (2 bit - 1) (low + step level)
            middle += align[None, :, level] * (self.low[:, None] * (2 * ones - self.d)[None, :] + self.step[:, None] * (2 * both - self.total[:, None])) / np.sqrt(self.d)
        width = rest[None, :] + align.sum(1)[None, :] * self.error[:, None] + 1e-9
        scale = self.norm[:, None] * norm[None, :]
        # scores are held within a long, so their bounds are too
        return np.clip((middle - width) * scale - 1, -_MOST, _MOST), np.clip((middle + width) * scale + 1, -_MOST, _MOST)


def scores(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of rows a[i] and b[j] of integers; beyond a long, its nearest end."""
    most = float(np.sqrt((a.astype(np.float64) ** 2).sum(1)).max(initial=0) * np.sqrt((b.astype(np.float64) ** 2).sum(1)).max(initial=0))
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), 1 << 16):
        x, y = a[i[k : k + (1 << 16)]], b[j[k : k + (1 << 16)]]
        if most < 1 << 62:
            out[k : k + len(x)] = np.einsum("ij,ij->i", x, y)
        else:
            out[k : k + len(x)] = [max(-_MOST, min(_MOST, sum(p * q for p, q in zip(u, v, strict=True)))) for u, v in zip(x.tolist(), y.tolist(), strict=True)]
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int64).reshape(len(column), -1)


def _best(order: list[np.ndarray], group: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the first n of each group, by the keys of order (the last is the first)."""
    by = np.lexsort([*order, group])
    g = group[by]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.empty(0, np.int64)
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return by[place < n]


def _nth(values: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest of each row; minus infinity where there are fewer."""
    if values.shape[1] < n:
        return np.full(len(values), -np.inf)
    return -np.partition(-values, n - 1, axis=1)[:, n - 1]


def codes_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """The stored codes: one row for each distinct (id, label, vector) that takes part, with a number rid."""
    v = F.col("v")
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # what leaves the range of a long is held at its ends by the cast
    ints = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(9.2e18)), F.lit(-9.2e18))))
    rows = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & fit).select("vec_id", "label", ints.alias("v")).distinct()
    size = rows.agg(F.max(F.size("v"))).first()[0] or 1
    d = max(64, 1 << (size - 1).bit_length())

    def run(batches):
        for pdf in batches:
            for k in range(0, len(pdf), max(1, PAIRS // d)):
                part = pdf.iloc[k : k + max(1, PAIRS // d)]
                ints = np.zeros((len(part), d), np.int64)
                for i, x in enumerate(part["v"]):
                    ints[i, : len(x)] = x
                words, norm, align, rest = encode(ints)
                yield pd.DataFrame({"rid": part["rid"], "vec_id": part["vec_id"], "label": part["label"], "ints": [x.tobytes() for x in ints], "code": [x.tobytes() for x in words], "norm": norm, "align": list(align), "rest": rest})

    # the numbers hold once they are written
    return materialize(rows.withColumn("rid", F.monotonically_increasing_id()).mapInPandas(run, CODES), "codes")


def _cells(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows with each block of anchors and anchors with each block of rows: groups (i, j), side 0 and 1.

    anchors has the columns of rows and perhaps more.
    """
    n = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_anchor"), 1))).first()
    down, across = max(1, -(-n[0] // ROWS)), max(1, -(-n[1] // ANCHORS))
    block = lambda k: F.pmod(F.xxhash64("rid"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.withColumns({"i": block(down), "side": F.lit(0)}).withColumn("j", each(across))
    right = anchors.withColumns({"j": block(across), "side": F.lit(1)}).withColumn("i", each(down))
    return left.unionByName(right, allowMissingColumns=True)


def _nearest(rows: DataFrame, n: int) -> DataFrame:
    """(anchor, rid, vec_id, score): the first n other rows of each anchor's label; of each block's best, the best."""
    anchors = rows.where("is_anchor")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, q = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        out = []
        if len(r) and len(q):
            codes = np.frombuffer(b"".join(r["code"]), np.uint64).reshape(len(r), -1)
            ints, qints = _matrix(r["ints"]), _matrix(q["ints"])
            ids, rids, labels = r["vec_id"].to_numpy(), r["rid"].to_numpy(), r["label"].to_numpy()
            norm, align, rest = r["norm"].to_numpy(), np.array(r["align"].tolist()), r["rest"].to_numpy()
            # a label's rows stand together, so that anchors meet those of their own label alone
            for label, mine in q.groupby("label").indices.items():
                here = np.flatnonzero(labels == label)
                step = max(1, PAIRS // max(1, len(here)))
                for k in range(0, len(mine) if len(here) else 0, step):
                    some = mine[k : k + step]
                    planes = Planes(qints[some])
                    low, high = planes.intervals(codes[here], norm[here], align[here], rest[here])
                    other = rids[here][None, :] != q["rid"].to_numpy()[some][:, None]
                    least = _nth(np.where(other, low, -np.inf), n)
                    a, b = np.nonzero(other & (high >= least[:, None]))
                    score = scores(qints, ints, some[a], here[b])
                    pick = _best([ids[here[b]], -score], a, n)
                    out.append(pd.DataFrame({"anchor": q["rid"].to_numpy()[some[a[pick]]], "rid": rids[here[b[pick]]], "vec_id": ids[here[b[pick]]], "score": score[pick]}))
        return pd.concat(out) if out else pd.DataFrame({"anchor": [], "rid": [], "vec_id": [], "score": []}).astype("int64")

    found = _cells(rows, anchors).groupBy("i", "j").applyInPandas(run, "anchor long, rid long, vec_id long, score long")
    return _first(found, ["anchor"], n)


def _first(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n of each key by score and vec_id, with their place; blocks give n each, which Spark cuts before it shuffles."""
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)


def _between(rows: DataFrame, positives: DataFrame, n: int, percent: int) -> DataFrame:
    """(anchor, goal, rid, vec_id, score, place): for each positive score (goal) of an anchor, the first n rows of other labels from percent of it up to it."""
    goals = positives.groupBy("anchor").agg(F.sort_array(F.collect_set("score")).alias("goals"))
    anchors = rows.where("is_anchor").join(goals, F.col("rid") == F.col("anchor")).drop("anchor")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, q = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        out = []
        if len(r) and len(q):
            codes = np.frombuffer(b"".join(r["code"]), np.uint64).reshape(len(r), -1)
            ints, qints = _matrix(r["ints"]), _matrix(q["ints"])
            ids, rids, labels = r["vec_id"].to_numpy(), r["rid"].to_numpy(), r["label"].to_numpy()
            norm, align, rest = r["norm"].to_numpy(), np.array(r["align"].tolist()), r["rest"].to_numpy()
            goals, anchor = q["goals"].tolist(), q["rid"].to_numpy()
            step = max(1, PAIRS // len(r))
            for k in range(0, len(q), step):
                some = np.arange(k, min(len(q), k + step))
                low, high = Planes(qints[some]).intervals(codes, norm, align, rest)
                other = labels[None, :] != q["label"].to_numpy()[some][:, None]
                wanted = np.zeros(low.shape, bool)
                for g in range(max(len(goals[i]) for i in some)):
                    # an anchor with fewer goals has its last one again
                    goal = np.array([goals[i][min(g, len(goals[i]) - 1)] for i in some], np.float64)[:, None]
                    floor = goal * percent / 100
                    pad = np.abs(goal) * 1e-12 + 1
                    sure = other & (low >= floor + pad) & (high <= goal - pad)
                    least = np.maximum(floor - pad, _nth(np.where(sure, low, -np.inf), n)[:, None])
                    wanted |= other & (high >= least) & (low <= goal + pad)
                a, b = np.nonzero(wanted)
                score = scores(qints, ints, some[a], b)
                for g in range(max(len(goals[i]) for i in some)):
                    goal = np.array([goals[i][g] if g < len(goals[i]) else 0 for i in some], np.int64)
                    has = np.array([g < len(goals[i]) for i in some])
                    ok = np.flatnonzero(has[a] & (score <= goal[a]))
                    ok = ok[[100 * s >= percent * p for s, p in zip(score[ok].tolist(), goal[a[ok]].tolist(), strict=True)]]
                    pick = ok[_best([ids[b[ok]], -score[ok]], a[ok], n)]
                    out.append(pd.DataFrame({"anchor": anchor[some[a[pick]]], "goal": goal[a[pick]], "rid": rids[b[pick]], "vec_id": ids[b[pick]], "score": score[pick]}))
        return pd.concat(out) if out else pd.DataFrame({"anchor": [], "goal": [], "rid": [], "vec_id": [], "score": []}).astype("int64")

    found = _cells(rows, anchors).groupBy("i", "j").applyInPandas(run, "anchor long, goal long, rid long, vec_id long, score long")
    return _first(found, ["anchor", "goal"], n)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors, the rows whose id is divisible by every.

    Components x become floor(scale * x); a score is the integer inner product
    with the anchor; higher scores come first, ties by smaller id. An anchor's
    positives are its first other rows of the same label. For each, its hard
    negatives are the first rows of other labels that score from percent of the
    positive's score up to that score.

    Rows with a null id, label or vector, or with a component that is null or
    not finite, take no part. Rows equal in id, label and vector count once;
    other rows of one id are rows of their own, an anchor's fellow too. Shorter
    vectors count as filled up with zeros. Scores and components beyond a long
    are held at its ends. Anchors without positives, and positives without
    negatives, give no rows; nor does an empty table. Other columns play no part.
    """
    rows = codes_of(vectors, id_col, vector_col, label_col, scale).withColumn("is_anchor", F.col("vec_id") % every == 0)
    near = materialize(_nearest(rows, positives), "positives")
    between = _between(rows, near, negatives, percent)
    names = rows.where("is_anchor").select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    goals = near.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("goal"))
    return goals.join(between, ["anchor", "goal"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("goal").alias("positive_score"), F.col("score").alias("negative_score")
    )
