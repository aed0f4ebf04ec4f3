"""Operator 11: periodic runs of words, by catching squares online over dyadic blocks.

Words are appended one after the other, as numbers. As soon as an aligned block
of 2^k words is complete, a catcher waits for it to come again at a distance p
of 2^(k+1)-1 to 2^(k+2)-2: the first half of every square of such a period holds
an aligned block of that size. The suffix of 2^k words that each appended word
completes meets two catchers a level, whatever came before, so a word costs
two comparisons of fingerprints for each level. Where a block comes again, the
words around both are compared, to the left and, as more are appended, to the
right. Once p words in a row agree with those p before, there is a square, and
it grows into the run that holds all squares of that period around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topograph.llm.text import byte_column, chunks, mix

#: Words that one numpy pass appends.
PART = 1 << 16
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = np.zeros(0, np.int64)


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """a with room for n values."""
    if n <= len(a):
        return a
    out = np.empty(max(n, 2 * len(a), 1024), a.dtype)
    out[: len(a)] = a
    return out


def _primes(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return [*out, n] if n > 1 else out


class SquareCatchers:
    """Takes words as numbers, in as many calls of append as one likes, and knows the runs of those so far.

    A negative number is a border that no square reaches over; no two may be
    equal. most is the largest period looked for, if one is known.
    """

    def __init__(self, most: int | None = None):
        self.most, self.n = most, 0
        self.words = np.empty(0, np.int64)
        self.borders = np.empty(0, np.int32)  # how many stand up to a place
        self.cover = np.empty(0, np.int32)  # of the runs over a place, the one that reaches furthest
        #: For each level the fingerprints of the blocks that wait, and of the last suffixes, each with the number of the first.
        self.blocks: list[tuple[int, np.ndarray]] = []
        self.suffixes: list[tuple[int, np.ndarray]] = []
        self.starts, self.ends, self.periods = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.found = 0
        #: Agreements that reach the last word: (period, start) -> number of the run, or -1 if it is no square yet.
        self.open: dict[tuple[int, int], int] = {}

    def append(self, words: np.ndarray) -> None:
        for a in range(0, len(words), PART):
            self._append(np.asarray(words[a : a + PART], np.int64))

    def _append(self, words: np.ndarray) -> None:
        old, n = self.n, self.n + len(words)
        self.words, self.borders, self.cover = _grown(self.words, n), _grown(self.borders, n), _grown(self.cover, n)
        self.words[old:n] = words
        self.borders[old:n] = np.cumsum(words < 0) + (self.borders[old - 1] if old else 0)
        self.cover[old:n] = -1
        self.n = n
        waiting, self.open = self.open, {}
        for (p, start), run in waiting.items():
            self._agree(start, self._forward(old, p), p, run, old)
        k = 0
        while 3 * (1 << k) - 1 <= n and (self.most is None or (2 << k) - 1 <= self.most):
            self._level(k)
            k += 1

    def _level(self, k: int) -> None:
        """The suffixes of 2^k words that are new meet the catchers of their level."""
        size, n = 1 << k, self.n
        if k == len(self.blocks):
            self.blocks.append((0, np.empty(0, np.uint64)))
            self.suffixes.append((0, np.empty(0, np.uint64)))
        first, kept = self.suffixes[k]
        low, high = first + len(kept), n - size + 1
        if k:
            base, shorter = self.suffixes[k - 1]
            new = mix(shorter[low - base : high - base] * _LEFT + shorter[low + size // 2 - base : high + size // 2 - base] * _RIGHT)
        else:
            new = mix(self.words[low:high].astype(np.uint64))
        # catchers whose longest distance is over are let go
        base, blocks = self.blocks[k]
        gone = max(0, min((low - 4 * size >> k) - base, len(blocks)))
        base, blocks = base + gone, np.concatenate([blocks[gone:], new[-low % size :: size]])
        self.blocks[k] = (base, blocks)
        # the next level's next suffix begins with one of these
        need = self.suffixes[k + 1][0] + len(self.suffixes[k + 1][1]) if k + 1 < len(self.suffixes) else 0
        if self.most is not None and (4 << k) - 1 > self.most:
            need = high
        self.suffixes[k] = (max(first, need), np.concatenate([kept, new])[max(0, need - first) :])
        place = np.arange(low, high)
        block = (place - 2 * size + 1) >> k
        found = [(_NONE, _NONE)]
        for b in (block, block - 1):
            here = np.flatnonzero(b >= 0)
            here = here[blocks[b[here] - base] == new[here]]
            s = b[here] << k
            found.append((s, place[here] - s))
        s, p = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = self.borders[s] == self.borders[s + p + size - 1]
        if self.most is not None:
            keep &= p <= self.most
        s, p = s[keep], p[keep]
        keep = ~self._known(s, p, size)
        self._hits(s[keep], p[keep], size)

    def _known(self, s: np.ndarray, p: np.ndarray, size: int) -> np.ndarray:
        """Which hits lie in a run whose period divides theirs: they add nothing, as all of their square has that period."""
        run = self.cover[s]
        out = run >= 0
        run = run[out]
        out[out] = (self.ends[run] >= s[out] + p[out] + size) & (p[out] % self.periods[run] == 0)
        return out

    def _hits(self, s: np.ndarray, p: np.ndarray, size: int) -> None:
        order = np.lexsort((s, p))
        s, p = s[order], p[order]
        cuts = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)]
        opened: dict[int, list[int]] = {}
        for q, start in self.open:
            opened.setdefault(q, []).append(start)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            period, at = int(p[a]), s[a:b]
            for start in opened.get(period, ()):
                at = at[at < start]
            if len(at) > 8:
                at = at[~self._known(at, np.full(len(at), period), size)]
            i = 0
            while i < len(at):
                here = int(at[i])
                i += 1
                end = self._forward(here + period, period)
                if end < here + period + size:
                    continue  # another block with the same fingerprint
                start = self._backward(here, period)
                self._agree(start, end, period, -1, start)
                i += int(np.searchsorted(at[i:], end - period - size, "right"))

    def _forward(self, end: int, p: int) -> int:
        """Where the words from end on stop agreeing with those p before."""
        w, n, step = self.words, self.n, 16
        while end < n:
            m = min(step, n - end)
            other = w[end : end + m] != w[end - p : end - p + m]
            j = int(other.argmax())
            if other[j]:
                return end + j
            end, step = end + m, min(2 * step, PART)
        return end

    def _backward(self, start: int, p: int) -> int:
        """The first of the words before start that agree with those p after."""
        w, step = self.words, 16
        while start:
            m = min(step, start)
            other = (w[start - m : start] != w[start - m + p : start + p])[::-1]
            j = int(other.argmax())
            if other[j]:
                return start - j
            start, step = start - m, min(2 * step, PART)
        return start

    def _agree(self, start: int, end: int, p: int, run: int, since: int) -> None:
        """All from start to end has period p: a run, if that is a square; it may go on if it reaches the last word."""
        if end - start >= 2 * p:
            if run < 0:
                run, since = self.found, start
                self.starts, self.ends, self.periods = (_grown(x, run + 1) for x in (self.starts, self.ends, self.periods))
                self.starts[run], self.periods[run] = start, p
                self.found += 1
            self.ends[run] = end
            over = self.cover[since:end]
            further = (over < 0) | (self.ends[over] < end)
            over[further] = run
        if end == self.n:
            self.open[p, start] = run

    def runs(self) -> np.ndarray:
        """(start, length, period) of each run so far by start and period; the period is the smallest, at least two of them fit."""
        out = set()
        for a, b, p in zip(self.starts[: self.found].tolist(), self.ends[: self.found].tolist(), self.periods[: self.found].tolist(), strict=True):
            w = self.words[a : a + 2 * p]
            if not any(np.array_equal(w[:p], w[p // f : p + p // f]) for f in _primes(p)):
                out.add((a, b - a, p))
        return np.array(sorted(out, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def text_runs(texts: list[bytes], exponent: int = 4, least: int = 6) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(number of words, runs, words that no run repeats joined by one space) of each text."""
    numbers: dict[bytes, int] = {}
    split = [t.split() for t in texts]  # at 0x20 and 0x09-0x0D
    sizes = np.array([len(x) for x in split], np.int64)
    total = int(sizes.sum()) + len(split)
    line = np.empty(total, np.int64)
    at = 0
    begins = []
    for i, words in enumerate(split):
        begins.append(at)
        line[at : at + len(words)] = [numbers.setdefault(w, len(numbers)) for w in words]
        at += len(words) + 1
        line[at - 1] = -1 - i
    catchers = SquareCatchers(most=int(sizes.max(initial=0)) // exponent)
    catchers.append(line)
    found = catchers.runs()
    found = found[found[:, 1] >= np.maximum(least, exponent * found[:, 2])]
    of = np.searchsorted(np.array(begins), found[:, 0], "right") - 1
    first = np.searchsorted(of, np.arange(len(split) + 1))
    for i, words in enumerate(split):
        mine = found[first[i] : first[i + 1]] - np.array([begins[i], 0, 0])
        if len(mine):
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, mine[:, 0] + mine[:, 2], 1)
            np.add.at(edge, mine[:, 0] + mine[:, 1], -1)
            words = compress(words, (np.cumsum(edge)[:-1] == 0).tolist())
        yield int(sizes[i]), [tuple(r) for r in mine.tolist()], b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """(id_col, n_words, runs, collapsed) for every row of docs.

    runs are the maximal stretches of at least `least` words and `exponent`
    times their smallest period, as structs (start, length, period) by start and
    period; they may overlap. collapsed holds the words that no run has after
    its first period, joined by one space. Words are what stands between the
    bytes 0x20 and 0x09-0x0D; they are compared byte by byte. A null or wordless
    text has no runs and collapses to an empty string. A null id stays null;
    rows that repeat stay apart, with equal results; an empty table gives none.
    Texts are read whole, beyond 1 MB one at a time, with memory in proportion
    to their words. Other columns of docs play no part.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column("text"))
            for a, b in chunks(offsets):
                rows = list(text_runs([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)], exponent, least))
                columns = [
                    batch.column("id").slice(a, b - a),
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for _, runs, _ in rows], kind),
                    pa.array([left for _, _, left in rows], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    out = given.mapInArrow(run, "id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")
    return out.select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text): every tenth document, by the checksum of its id, with a periodic end made of its own words.

    With h = crc32 of the decimal id and g = floor(h / 10), a document of n > 0
    words whose h is divisible by 10 has from word a = g % n on the word
    a + (i - a) % p in place of word i, p = 1 + floor((n - a) / (3 + g % 8)).
    Others, those of a null id and wordless ones keep their text.
    """
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    h = F.crc32(F.col("id").cast("string").cast("binary"))
    # only the texts that change are split
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    x = given.withColumns({"g": F.floor(h / 10), "words": words}).withColumn("n", F.size("words"))
    x = x.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    x = x.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    turned = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return x.select(F.col("id").alias(id_col), F.when(F.col("a").isNotNull(), F.concat_ws(" ", turned)).otherwise(F.col("text")).alias(text_col))


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of periodic_runs.

    The run named is the one of the greatest length / period, compared exactly;
    of equals the first by start and period. Without a run its columns are null.
    """

    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    nothing = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    x = found.withColumn("best", F.aggregate("runs", nothing, better))
    return x.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
