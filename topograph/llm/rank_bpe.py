"""Operator 12: byte-level BPE over a table of ranks by a queue of ranks, and decoding.

The tokens of all distinct pieces of a batch stand in one linked list, in which
no link leads out of a piece. Every pair of neighbours whose joined bytes have a
rank waits, by its position, in the bucket of that rank. A hierarchical bitmap
tells which buckets hold anything: a bit of one level stands for a word of 64
bits of the level below, so the least rank is found by one find-first-set on
each level. Its whole bucket is merged at once, and what the merges bring about
waits in other buckets. An entry whose pair has changed since is stale and
skipped; nothing is ever looked for. A piece of n bytes costs O(n log n),
however long it is, and pieces share the steps.

The rule for one piece is: least rank first, of equals the leftmost. The least
rank of all pieces is also the least of each piece that has it. Within a piece
the pairs of one rank are merged together, every other one where they overlap,
unless a merge brings about a pair of a smaller rank, which goes first: then
those right of it wait for their rank to come again. (In trained tables that is
rare; a piece in which it happens n times costs n more passes over what waits.)
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of distinct pieces that are merged together, pieces of texts in one Arrow batch; a longer text or piece stands alone.
TOGETHER, PIECES = 1 << 21, 1 << 22
#: Characters of a text up to which its pieces are listed at once.
LISTED = 1 << 20


class RankQueue:
    """Buckets of positions by rank; pop gives the bucket of the least rank."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.levels: list[list[int]] = []
        while True:
            ranks = (ranks + 63) >> 6
            self.levels.append([0] * max(1, ranks))
            if ranks <= 1:
                break

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            before = level[word]
            level[word] = before | bit
            if before:
                break
            rank = word

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Each position into the bucket of its rank; -1 is no rank."""
        some = ranks >= 0
        ranks, positions = ranks[some], positions[some]
        if len(ranks) > 1:
            order = ranks.argsort(kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = [0, *((ranks[1:] != ranks[:-1]).nonzero()[0] + 1).tolist(), len(ranks)]
            for rank, a, b in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
                self.push(rank, positions[a:b])
        elif len(ranks):
            self.push(int(ranks[0]), positions)

    def pop(self) -> tuple[int, np.ndarray] | None:
        """(rank, its positions in order), or None if nothing waits."""
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            if not word:
                return None
            rank = rank << 6 | ((word & -word).bit_length() - 1)
        at = rank
        for level in self.levels:
            level[at >> 6] &= ~(1 << (at & 63))
            if level[at >> 6]:
                break
            at >>= 6
        bucket = self.buckets.pop(rank)
        positions = np.sort(np.concatenate(bucket)) if len(bucket) > 1 else np.sort(bucket[0])
        if len(positions) > 1:
            positions = positions[np.append(True, positions[1:] != positions[:-1])]
        return rank, positions


class Ranks:
    """A table of ranks (bytes -> id): the ranks of pairs, and the bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.queue = RankQueue(size)
        pairs = {}
        #: Ranks whose pairs may be merged together.
        self.safe = np.ones(size, bool)
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
                    self.safe[[x for x in (a, b) if x > rank]] = False
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.values = np.append(np.array([pairs[k] for k in keys.tolist()], np.int32), np.int32(-1))
        plain = [b""] * size
        for token, rank in ranks.items():
            plain[rank] = token
        self.known = np.array([len(x) > 0 for x in plain])
        self.sizes = np.array([len(x) for x in plain], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(plain), np.uint8)

    @classmethod
    def read(cls, file: str) -> Ranks:
        with open(file, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        return cls({base64.b64decode(b): int(i) for b, i in rows})

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each two tokens joined; -1 where they make no token, or one of them is -1."""
        key = a.astype(np.int64) << 32 | b
        at = self.keys.searchsorted(key)
        at[self.keys.take(at, mode="clip") != key] = len(self.keys) - 1
        return self.values[at]

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of pieces: a piece that is a token is that token, of others what merging leaves."""
        whole = [self.ranks.get(p, -1) for p in pieces]
        rest = [p for p, i in zip(pieces, whole, strict=True) if i < 0 and p]
        ids, counts = self._merge(rest)
        alone = np.array(whole, np.int64)
        sizes = (alone >= 0).astype(np.int64)
        merged = (alone < 0) & np.array([len(p) > 0 for p in pieces], bool)
        sizes[merged] = counts
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        of = np.repeat(merged, sizes)
        out[of], out[~of] = ids, alone[alone >= 0]
        return out, ends

    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of them for each piece) of pieces that are no token."""
        if not pieces:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        sizes = np.array([len(p) for p in pieces])
        starts = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        token = np.append(self.first[np.frombuffer(b"".join(pieces), np.uint8)], np.int32(-1))
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[starts + sizes - 1] = before[starts] = n  # no neighbour
        waits = np.append(self.pair(token[:n], token[after[:n]]), np.int32(-1))
        queue = self.queue
        queue.push_all(waits, np.arange(n + 1, dtype=np.int32))
        while (least := queue.pop()) is not None:
            rank, at = least
            at = at[waits[at] == rank]  # the others are stale
            if len(at) > 1:
                every, follows = at, np.append(False, after[at[:-1]] == at[1:])
                if follows.any():
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0]
                if not self.safe[rank]:
                    now = self._up_to_smaller(rank, at, token, before, after, starts)
                    if not now.all():
                        # all of those pieces wait again; which overlap then may differ
                        queue.push(rank, every[np.isin(starts.searchsorted(every, "right"), starts.searchsorted(at[~now], "right"))])
                        at = at[now]
            if not len(at):
                continue
            gone = after[at]
            right = after[gone]
            token[at] = rank
            token[gone] = waits[gone] = -1
            after[at] = right
            before[right] = at
            left = before[at]
            left = left[left < n]
            changed = np.concatenate([at, left])
            waits[changed] = new = self.pair(token[changed], token[after[changed]])
            queue.push_all(new, changed)
        alive = token[:n] >= 0
        return token[:n][alive], np.add.reduceat(alive, starts, dtype=np.int64)

    def _up_to_smaller(self, rank: int, at: np.ndarray, token: np.ndarray, before: np.ndarray, after: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which merges of rank to make now: of each piece those up to the first that brings about a pair of a smaller rank."""
        same = np.full(len(at), rank, np.int32)
        smaller = np.zeros(len(at), bool)
        for a, b in ((token[before[at]], same), (same, token[after[after[at]]]), (same, same)):
            new = self.pair(a, b)
            smaller |= (new >= 0) & (new < rank)
        if not smaller.any():
            return ~smaller
        piece = starts.searchsorted(at, "right")
        passed = np.cumsum(smaller) - smaller  # those before, in all pieces
        return passed == passed[piece.searchsorted(piece)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, their number for each id); an id outside the table is an error, as in the library."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the table")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.begins[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], sizes


class Numbers(dict):
    """Numbers of distinct pieces, in the order in which they first occur."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def pieces_of(text: str, pattern: regex.Pattern, numbers: Numbers) -> np.ndarray:
    """The numbers of the pieces of a text."""
    if len(text) <= LISTED:
        return np.fromiter(map(numbers.__getitem__, pattern.findall(text)), np.int32)
    found, out = pattern.finditer(text), []
    while part := [numbers[m[0]] for m in islice(found, 1 << 16)]:
        out.append(np.array(part, np.int32))
    return np.concatenate(out)


def encode_texts(texts: list[str], ranks: Ranks, pattern: regex.Pattern) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, ends) of texts, for runs of them that together hold PIECES pieces at most, or one text."""
    a = 0
    while a < len(texts):
        numbers, found, total, b = Numbers(), [], 0, a
        while b < len(texts) and (b == a or total + len(texts[b]) // 2 <= PIECES):
            found.append(pieces_of(texts[b], pattern, numbers))
            total += len(found[-1])
            b += 1
        ids, ends = [], [np.zeros(1, np.int64)]
        part: list[bytes] = []
        size = 0
        for n, piece in enumerate(numbers, 1):
            part.append(piece.encode("utf-8", "replace"))
            size += len(part[-1])
            if size >= TOGETHER or n == len(numbers):
                some, upto = ranks.encode(part)
                ids.append(some)
                ends.append(upto + ends[-1][-1])
                part, size = [], 0
        flat, cuts = np.concatenate([np.empty(0, np.int32), *ids]), np.concatenate(ends)
        pieces = np.concatenate(found)
        sizes = np.diff(cuts)[pieces]
        upto = np.cumsum(sizes)
        out = flat[np.repeat(cuts[pieces] - (upto - sizes), sizes) + np.arange(int(upto[-1]) if len(upto) else 0)]
        upto = np.concatenate([[0], upto])
        yield out, upto[np.cumsum([len(x) for x in found])]
        a = b


def text_ids(text: str, ranks: Ranks, pattern: str) -> list[int]:
    return next(encode_texts([text], ranks, regex.compile(pattern)))[0].tolist()


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def table(file: str) -> Ranks:
    """One for each worker process."""
    return Ranks.read(file)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """(id_col, ids array<int>) for every row: the ids of its text, each match of pattern encoded alone.

    A null or empty text has no ids (an empty array). Bytes that are no UTF-8
    count as replacement characters. A null id stays null; rows that repeat stay
    apart; an empty table gives none. Texts of any length are encoded whole;
    memory is in proportion to the longest text. Other columns of docs play no
    part. Every worker opens the rank file where its own Python has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, split = table(vocabulary(name)), regex.compile(split_pattern() if pattern is None else pattern)
        for batch in batches:
            texts = [(t.as_py() or b"").decode("utf-8", "replace") for t in batch.column("text")]
            at = 0
            for ids, ends in encode_texts(texts, ranks, split):
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(ends)), lists], ["id", "ids"])
                at += len(ends)

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return given.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """(id_col, ids, decoded binary) for every row: the bytes of its ids. Null ids count as none; an id outside the table is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = table(vocabulary(name))
        for batch in batches:
            given = batch.column("ids")
            for i in range(0, len(given), 256):
                lists = given.slice(i, 256)
                ids = lists.flatten().to_numpy()
                data, sizes = ranks.decode(ids)
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])]
                plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, 256), lists, plain.cast(pa.binary())], ["id", "ids", "decoded"])

    given = coded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return given.mapInArrow(run, "id long, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): of the decimal ids joined by commas, and of the decoded bytes."""
    both = decode(encode(docs, id_col, text_col, name), id_col, "ids", name)
    return both.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
