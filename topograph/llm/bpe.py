"""Operator 5: byte-level BPE by a tokenization automaton, and decoding by its arc labels.

The automaton over tokens accepts exactly the sequences that merging would
give. It starts as one state with an arc for each byte; every merge (u, v), in
order, adds a gadget: wherever an arc u led to a state with an arc v, that arc v
is taken away and a new arc uv leads to a copy of the state after v. So a
state is named by the arc that leads to it, and has(x, y), whether arc y leaves
the state after arc x, follows from the gadgets of x and y alone; the whole
table would have some 10^9 entries.

From it the automaton over bytes is compiled by taking sets: a state is all
places in arcs where one may stand after the bytes read so far. Exactly one path
spells any run of bytes, so every state also knows the last arc of the path that
ends there. States are compiled when they first occur and kept in one
transition table; encoding looks up one transition for each byte, for all words
of a batch at a time, and then walks back over the last arcs. There is no search.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.llm.text import byte_column, chunks

# The Unicode White_Space characters, and the words that stand alone after an apostrophe.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]
#: Classes of characters; a token never reaches from one into another, but for one space before.
WHITE, LETTER, NUMBER, OTHER, OUTSIDE = range(5)
#: Ends a text in a joined buffer; no UTF-8 text has this byte.
STOP = 0xFF
#: Transitions that a worker keeps before it starts anew (some 80 MB with their states), words that are read byte by byte alone, bytes read at a time.
TRANSITIONS, ALONE, PART = 1 << 19, 512, 1 << 18
_MULTIPLIER, _FREE = 0x9E3779B97F4A7C15, np.uint64(0xFFFFFFFFFFFFFFFF)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself where it is printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    points = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")])
    text = points.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            out[points[m.start()] : points[m.end() - 1] + 1] = kind
    out[0xD800:0xE000] = OTHER
    out[WHITE_SPACE] = WHITE
    return out


def kinds(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 belongs to; OUTSIDE for STOP."""
    table = _kinds()
    plain = np.full(256, OTHER, np.uint8)
    plain[:128] = table[:128]
    plain[STOP] = OUTSIDE
    out = plain[data]
    lead = np.flatnonzero((data >= 0xC0) & (data < 0xF8))
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    for n in (2, 3, 4):
        at = lead[size == n]
        if len(at):
            point = (data[at] & (0x7F >> n)).astype(np.int64)
            for j in range(1, n):
                point = point << 6 | data[at + j] & 0x3F
            kind = table[point]
            for j in range(n):
                out[at + j] = kind
    return out


def words(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words that merging doesn't leave.

    Words are runs of one class, with the space before them. Of several white
    characters before a word all but the last are a word, and the last is one
    too unless it is a space. An apostrophe that starts a word takes the short
    words with it.
    """
    n = len(data)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    after = np.append(runs[1:], n)
    white = (kind[runs] == WHITE) & (after < n)
    white[white] = kind[after[white]] != OUTSIDE
    after = after[white]
    last = after - 1
    for _ in range(3):
        last -= (data[last] & 0xC0) == 0x80
    start[last] = True
    start[after[data[last] == 0x20]] = False
    quote = np.flatnonzero((data == 0x27) & start)
    quote = quote[quote < n - 1]
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        for short in SHORT:
            hit = np.ones(len(quote), bool)
            for j, b in enumerate(short, 1):
                hit &= padded[quote + j] == b
            start[quote[hit] + 1] = False
            stop = quote[hit] + 1 + len(short)
            start[stop[stop < n]] = True
            quote = quote[~hit]
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    inside = kind[starts] != OUTSIDE
    return starts[inside], ends[inside]


class Automaton:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        letters = byte_letters()
        self.special = special
        self.labels = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in special}
        self.labels |= {i: t.encode() for t, i in special.items()}
        self.cut = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(special, key=len, reverse=True))) if special else None
        self.most = max(self.labels, default=0) + 2
        #: number of the merge of a pair; of an arc: the number of its gadget and its two parts
        self.time = len(merges)
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        self.known: dict[int, bool] = {}
        arcs = {vocab[c] for c in letters if c in vocab}
        for n, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((u, v), n)
            if u in arcs and v in arcs and w not in self.made and self._has(u, n - 1, v):
                self.made[w] = n, u, v
                arcs.add(w)
        self._compile_labels(arcs)
        self._start()

    @classmethod
    def read(cls, file: str) -> Automaton:
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        return cls(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], {t["content"]: t["id"] for t in spec["added_tokens"]})

    def _has(self, x: int, time: int, y: int) -> bool:
        """Whether the state after arc x has an arc y once the gadgets up to number time have been added."""
        while True:
            born, a, _ = self.made.get(y, (-1, -1, -1))
            if born > time:
                return False
            own, _, right = self.made.get(x, (-1, -1, -1))
            taken = self.rank.get((x, y))
            if taken is not None and own < taken <= time:
                return False
            if born > own:  # the gadget of y met this state: it gave y if the state then had y's first part
                time, y = born, a
            elif own < 0:
                return True
            else:  # x's state is a copy of the one after its second part, as of x's own gadget
                if born == own:
                    y = a
                x, time = right, own - 1

    def has(self, x: int, y: int) -> bool:
        """Whether arc y leaves the state after arc x of the finished automaton; any arc leaves the first state, x = -1."""
        if x < 0:
            return True
        key = x * self.most + y
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= TRANSITIONS // 4:
                self.known.clear()
            found = self.known[key] = self._has(x, self.time, y)
        return found

    def _compile_labels(self, arcs: set[int]) -> None:
        """The places in arcs as a tree: child[place << 8 | byte], the arc that ends at a place, and the arcs further on if there are few."""
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        further: list[list[int]] = [[]]
        for arc in sorted(arcs):
            at = 0
            for b in self.labels[arc]:
                if at and len(further[at]) < 9:
                    further[at].append(arc)
                key = at << 8 | b
                at = self.child.get(key, -1)
                if at < 0:
                    at = self.child[key] = len(self.ends)
                    self.ends.append(-1)
                    further.append([])
            self.ends[at] = arc
        self.further: list[tuple[int, ...] | None] = [tuple(x) if len(x) < 9 else None for x in further]
        size = max(self.labels, default=-1) + 1
        self.sizes = np.zeros(size, np.int64)
        for i, x in self.labels.items():
            self.sizes[i] = len(x)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.labels.get(i, b"") for i in range(size)), np.uint8)
        decimals = [f"{i}," for i in range(size)]
        self.decimal_sizes = np.array([len(x) for x in decimals], np.int64)
        self.decimals = np.array(decimals, "S").view(np.uint8).reshape(size, -1) if size else np.zeros((0, 1), np.uint8)

    def _start(self) -> None:
        """Forget all states but the first."""
        #: members as packed numbers, a quarter of the memory of tuples
        self.states: list[bytes] = [bytes(8)]
        self.numbers: dict[bytes, int] = {bytes(8): 0}
        self.known.clear()
        self.last = np.full(1 << 12, -1, np.int32)
        self.count, self.bits = 0, 16
        self.slots = np.full(1 << self.bits, _FREE, np.uint64)
        self.single: dict[int, int] = {}

    def _next(self, state: int, byte: int) -> int:
        """Compile one transition; a member of a state is a place in an arc and the arc before it."""
        out, members, most = -1, array("q"), self.most
        for member in array("q", self.states[state]):
            place, x = divmod(member, most)
            place = self.child.get(place << 8 | byte, -1)
            if place < 0:
                continue
            y = self.ends[place]
            if y >= 0 and self.has(x - 1, y):
                out = y
            further = self.further[place]
            if further is None or any(self.has(x - 1, z) for z in further):
                members.append(place * most + x)
        if out < 0:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        members.append(out + 1)
        key = members.tobytes()
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            if number >= len(self.last):
                self.last = np.concatenate([self.last, np.full(len(self.last), -1, np.int32)])
            self.last[number] = out
        return number

    def _put(self, packed: np.ndarray) -> None:
        """Add transitions, packed with their keys, to the table."""
        while 2 * (self.count + len(packed)) > len(self.slots):
            old = self.slots[self.slots != _FREE]
            self.bits += 1
            self.slots = np.full(1 << self.bits, _FREE, np.uint64)
            self._place(old)
        self._place(packed)
        self.count += len(packed)

    def _place(self, packed: np.ndarray) -> None:
        slot = self._slot(packed >> np.uint64(32))
        while len(packed):
            free = self.slots[slot] == _FREE
            self.slots[slot[free]] = packed[free]  # of two that meet one stays
            left = self.slots[slot] != packed
            packed, slot = packed[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(_MULTIPLIER)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that transitions lead to, and the places of those that the table lacks."""
        slot = self._slot(key)
        found = self.slots[slot]
        wrong = np.flatnonzero((found >> np.uint64(32)) != key)
        missing = []
        while len(wrong):
            none = found[wrong] == _FREE
            missing.append(wrong[none])
            wrong = wrong[~none]
            slot[wrong] = (slot[wrong] + 1) & (len(self.slots) - 1)
            found[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(found[wrong] >> np.uint64(32)) != key[wrong]]
        return found & np.uint64(0xFFFFFFFF), np.concatenate(missing) if missing else wrong

    def step(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The states after one more byte each."""
        key = states << np.uint64(8) | data
        found, missing = self._find(key)
        if len(missing):
            new = np.unique(key[missing])
            to = np.array([self._next(k >> 8, k & 255) for k in new.tolist()], np.uint64)
            self._put(new << np.uint64(32) | to)
            found[missing] = to[np.searchsorted(new, key[missing])]
        return found

    def _alone(self, word: bytes) -> np.ndarray:
        """The last arcs of one very long word."""
        state, single, out = 0, self.single, []
        for b in word:
            key = state << 8 | b
            state = single.get(key, -1)
            if state < 0:
                if len(single) >= TRANSITIONS:
                    single.clear()
                state = single[key] = self._next(key >> 8, b)
            out.append(state)
        return self.last[out]

    def spell(self, data: np.ndarray, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(places, ids): the tokens of texts joined by STOP, and the place of the last byte of each."""
        if len(self.states) > TRANSITIONS // 2 or self.count > TRANSITIONS:
            self._start()
        kind = kinds(data)
        token = np.full(len(data), -1, np.int32)
        ends_here = np.zeros(len(data), bool)
        if special and self.cut:
            for m in self.cut.finditer(data):
                kind[m.start() : m.end()] = OUTSIDE
                token[m.end() - 1] = self.special[m[0].decode()]
                ends_here[m.end() - 1] = True
        starts, ends = words(data, kind)
        size = ends - starts
        for a, b in zip(starts[size > ALONE].tolist(), ends[size > ALONE].tolist(), strict=True):
            token[a:b] = self._alone(data[a:b].tobytes())
        short = size <= ALONE
        order = np.argsort(-size[short].astype(np.int16), kind="stable")
        at = starts[short][order]
        still = len(at) - np.cumsum(np.bincount(size[short], minlength=1))  # words of more bytes than this
        state = np.zeros(len(at), np.uint64)
        for n in still.tolist():
            if not n:
                break
            at = at[:n]
            state = self.step(state[:n], data[at])
            token[at] = self.last[state.astype(np.int64)]
            at = at + 1
        at = ends - 1
        while len(at):
            ends_here[at] = True
            at = at - self.sizes[token[at]]
            more = at >= starts
            at, starts = at[more], starts[more]
        places = np.flatnonzero(ends_here)
        return places, token[places]

    def rows(self, data: np.ndarray, offsets: np.ndarray, special: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(a, b, ids, ends): the ids of rows a to b, which end at ends."""
        for a, b in chunks(offsets, PART):
            if b == a + 1:
                parts = [self.spell(x, special)[1] for x in _parts(data[offsets[a] : offsets[b]])]
                ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
                yield a, b, ids, np.array([len(ids)])
                continue
            bounds = offsets[a : b + 1] - offsets[a]
            joined = np.full(int(bounds[-1]) + b - a, STOP, np.uint8)
            inside = np.ones(len(joined), bool)
            stops = bounds[1:] + np.arange(b - a)
            inside[stops] = False
            joined[inside] = data[offsets[a] : offsets[b]]
            places, ids = self.spell(joined, special)
            yield a, b, ids, np.searchsorted(places, stops)

    def encode(self, text: str, special: bool = True) -> list[int]:
        """Ids of text; with special = False, strings of special tokens are ordinary text."""
        data = np.frombuffer(text.encode(), np.uint8)
        return next(iter(self.rows(data, np.array([0, len(data)]), special)))[2].tolist()

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, ends): the labels of the arcs, one after the other, and where each ends."""
        size = self.sizes[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[ids] - (ends - size), size) + np.arange(total)], ends

    def decimals_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, ends): decimal ids with a comma after each."""
        size = self.decimal_sizes[ids]
        return self.decimals[ids][np.arange(self.decimals.shape[1]) < size[:, None]], np.cumsum(size)

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one after the other; bytes that are no UTF-8 give replacement characters."""
        return self.bytes_of(np.array(ids, np.int64))[0].tobytes().decode("utf-8", "replace")


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text in parts of about PART bytes, cut where white space follows printable ASCII: a word begins there."""
    a = 0
    while a < len(data):
        b = a + PART
        while b < len(data):
            some = data[b - 1 : b + PART]
            cut = np.flatnonzero(((some[1:] == 0x20) | (some[1:] == 0x0A)) & (some[:-1] > 0x20) & (some[:-1] < 0x7F))
            if len(cut):
                b += int(cut[0])
                break
            b += PART
        yield data[a:b]
        a = b


@lru_cache(maxsize=2)
def automaton(file: str) -> Automaton:
    """One automaton for each worker process.

    Its tables hold no cycles, so the collector is told to pass them over.
    """
    out = Automaton.read(file)
    gc.freeze()
    gc.set_threshold(200_000, 20, 100)
    return out


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k.json", keep: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) for every row; with keep, also ids and decoded.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the
    UTF-8 text decoded from the ids. A null text counts as empty: no ids, both
    digests of nothing. A null id stays null; rows that repeat stay apart, in
    the order given; an empty table gives none. Long texts are read in parts of
    1 MB. Other columns play no part. Every worker opens the vocabulary file
    where its own Python has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(vocabulary(name))
        for batch in batches:
            data, offsets = byte_column(batch.column("text"))
            for a, b, ids, ends in auto.rows(data, offsets):
                decimals, upto = auto.decimals_of(ids)
                plain, until = auto.bytes_of(ids)
                cuts = np.concatenate([[0], ends])
                at = np.concatenate([[0], upto])[cuts].tolist()
                of = np.concatenate([[0], until])[cuts].tolist()
                joined, plain = decimals.tobytes(), plain.tobytes()
                texts = [plain[p:q].decode("utf-8", "replace") for p, q in zip(of, of[1:], strict=False)]
                columns = [
                    batch.column("id").slice(a, b - a),
                    pa.array(np.diff(cuts), pa.int64()),
                    pa.array([hashlib.sha256(joined[p : max(p, q - 1)]).hexdigest() for p, q in zip(at, at[1:], strict=False)], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                ]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    columns += [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, schema).withColumnRenamed("id", id_col)
