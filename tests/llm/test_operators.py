"""Each operator against a brute-force version, and on nulls, empty and long texts, repeats and empty tables."""

import hashlib
import io
import random
import re
import tracemalloc
import zlib
from fractions import Fraction as F_

import numpy as np
import pytest
from pyspark.sql import functions as F

from topograph.llm import bpe, decontaminate, html_extract, media, near_dedup, quality, repeats, sharding, text, token_counts, url_filter

SCHEMA = "doc_id long, text string, id string, cls long, key string, n long"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (None, "no id at all"), (5, "Ünï <|endoftext|> 漢字 🙂"), (5, "another text"), (6, "word " * 3000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "k", 2) for i, t in rows], SCHEMA)


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeghinorst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(40))
    docs = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        if i % 5 == 0:
            words += shared.split()
        if i % 4 == 3:
            words = docs[i - rng.randint(1, 3)][1].split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((i * 7 % n, " ".join(words)))
    return docs


def brute_components(docs, k, percent):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for i, t in docs:
        w = [x.translate(low) for x in words.findall(t)]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    of = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and of[a] < of[b]:
                    of[b], changed = of[a], True
    return of, sets


@pytest.mark.parametrize("block", [2048, 2])
def test_near_duplicates(spark, block):
    rng = random.Random(3)
    chain = [f"c{i}" for i in range(120)]
    docs = corpus() + [(100 + i, " ".join(chain[: 100 - i] + [f"d{rng.randrange(9)}" for _ in range(i)])) for i in range(20)]  # many buckets of several components
    of, sets = brute_components(docs, 4, 80)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(frame(spark, docs), block=block).collect()}
    assert {i: r.component_id for i, r in got.items()} == of
    assert all(r.n_shingles == len(sets[i]) and r.kept == (of[i] == i) for i, r in got.items())


def test_block_links_joins_groups_that_a_star_leaves_apart():
    a = np.arange(100)
    sets = [np.sort(np.concatenate([a[:90], 1000 * (i + 1) + np.arange(10)])) for i in range(2)] + [a]
    found = near_dedup.block_links(np.array([1, 2, 3]), sets, np.array([1, 2, 3]), np.zeros(3), 80)
    assert sorted(found) == [(1, 2), (1, 3)] or len(found) == 2


def test_near_duplicates_of_odd_rows(spark):
    rows = near_dedup.near_duplicates(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by = {(r.doc_id, r.n_shingles): r for r in rows}
    assert all(by[i, 0].component_id == i for i in (1, 2, 3)) and by[4, 1].kept
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, False)]
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_words_and_signatures():
    data = np.frombuffer(b"A b\tc" + "é".encode() + b"A b", np.uint8)
    hashes, rows = text.words(data, np.array([0, 5, 7, 7, 10]))
    assert rows.tolist() == [0, 3, 4, 4, 6] and hashes[0] == hashes[4] and hashes[1] == hashes[5]
    assert len(near_dedup.signature(np.array([5], np.uint64))) == near_dedup.BINS
    rng = np.random.default_rng(0)
    a, b = np.sort(rng.integers(0, 2**63, 900).astype(np.uint64)), np.sort(rng.integers(0, 2**63, 900).astype(np.uint64))
    mixed = np.sort(np.concatenate([a[::2], b[::2]]))
    same = (near_dedup.signature(text.mix(a)[np.argsort(text.mix(a))]) == near_dedup.signature(np.sort(text.mix(mixed)))).mean()
    assert abs(same - 450 / 1350) < 0.1


def brute_repeats(docs, n=repeats.LENGTH):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = t.encode()
        mark = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if b[s : s + n] in seen:
                mark[s : s + n] = b"\1" * n
            seen.add(b[s : s + n])
        kept = bytes(x for x, y in zip(b, mark, strict=True) if not y)
        spans = sum(1 for p, q in zip(b"\0" + mark, mark, strict=False) if q and not p)
        out[i] = (len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [100_000, 1])
def test_repeats(spark, hot):
    docs = [*corpus(40, 3), (1000, "ab" * 300), (1001, "z" * 500), (1002, "ab" * 200 + "q"), (1003, "z" * 99), (1004, "é" * 130), (1005, "é" * 130)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(frame(spark, docs), hot=hot).collect()}
    assert got == brute_repeats(docs)


def test_repeats_of_odd_rows(spark):
    found = repeats.remove_repeats(frame(spark, ODD))
    rows = found.collect()
    assert len(rows) == len(ODD)
    assert all(r.n_removed == 0 for r in rows if r.doc_id != 6)
    left = repeats.kept_texts(frame(spark, ODD), found)
    assert left.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") and left.count() == len(ODD)
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("other", [[], [(7, "another text")]])
@pytest.mark.parametrize("hot", [100_000, 1])
def test_repeats_of_repeated_rows(spark, hot, other):
    docs = [*corpus(12, 5), (1000, "ab" * 300)]
    want = brute_repeats(docs)
    twice = [(i, t) for i, t in docs if i in (0, 7, 1000)]
    docs = [*docs, *twice, *twice, *[(100 + i, t) for i, t in other], *[(100 + i, t + "!") for i, t in other]]
    rows = repeats.remove_repeats(frame(spark, docs), hot=hot).collect()
    assert len(rows) == len(docs)
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in rows if r.doc_id in want)


def test_suffix_order_against_sorting():
    for seed in range(40):
        rng = random.Random(seed)
        letters = b"ab" if seed % 2 else bytes(range(97, 123))
        data = bytes(rng.choice(letters) for _ in range(rng.randint(1, 400)))
        data = data * rng.randint(1, 4) + b"a" * rng.randint(0, 300)
        array = np.frombuffer(data, np.uint8)
        order = repeats.suffix_order(array, repeats._packed(array))
        assert sorted(order.tolist()) == list(range(len(data)))
        first = [data[i : i + repeats.LENGTH].ljust(repeats.LENGTH, b"\0") for i in order]
        assert first == sorted(first)


def test_repeats_of_extreme_ids_and_clashing_columns(spark):
    docs = [*corpus(12, 5), (1000, "ab" * 300)]
    far = [((1 << 62) + i, t) for i, t in docs]
    rows = repeats.remove_repeats(frame(spark, [*far, (-(1 << 63), "x"), (far[0][0], "another text")])).collect()
    want = brute_repeats(docs)
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id - (1 << 62)] for r in rows if r.n_bytes > 20)
    clash = frame(spark, docs)
    for name in ("_id", "_sha", "_starts", "_ends", "id", "sha", "starts", "ends", "row", "did"):
        clash = clash.withColumn(name, F.lit(1))
    left = repeats.kept_texts(clash, repeats.remove_repeats(clash))
    assert left.columns == clash.columns and {r.doc_id: len(r.text) for r in left.collect()} == {i: n - gone for i, (n, gone, _, _) in want.items()}


def test_repeats_with_the_kept_text(spark):
    docs = [*corpus(12, 5), (1000, "ab" * 300), (1000, "ab" * 300), (None, "ab" * 300), (1001, None)]
    rows = repeats.remove_repeats(frame(spark, docs), keep_text=True).collect()
    assert len(rows) == len(docs) and any(r.n_removed for r in rows)
    assert all(len(r.kept.encode()) == r.n_bytes - r.n_removed and hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in rows)


def test_repeats_across_segments_of_a_long_text():
    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.choice(b"abcd ") for _ in range(3 * (1 << 16))), np.uint8)
    place, key, first, last = repeats.anchors(data)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    assert np.array_equal(np.sort(starts), np.arange(len(data) - repeats.LENGTH + 1))
    assert ((place >= last) & (place + repeats.Q <= first + repeats.LENGTH)).all()


def test_bpe_against_the_library(spark):
    from tokenizers import Tokenizer

    file = bpe.vocabulary()
    auto, other = bpe.Automaton.read(file), Tokenizer.from_file(file)
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz   AB..,'!-=*12\n\téü漢　\xa0"
    texts = ["", "  a  b\n\n c", "x<|endoftext|> y", "it's WE'LL 's ''s 'sx \n's 're'x", "a" * 700, "  x\x1c\x1dy\x85z", "🙂🙂 日本語", "-" * 40, "<|endoftext|><|endoftext|>  ", " 　 x", "　　", "'", "it'"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    for t, e in zip(texts, other.encode_batch(texts, add_special_tokens=False), strict=True):
        assert auto.encode(t) == e.ids
        assert auto.decode(e.ids) == other.decode(e.ids, skip_special_tokens=False) == t
    rows = bpe.encode_decode(frame(spark, ODD), keep=True).collect()
    for (i, t), r in zip(ODD, rows, strict=True):
        ids = other.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids, r.decoded) == (i, len(ids), ids, t or "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_decode(frame(spark, [])).count() == 0


def merged(merges, word):
    """Tokens of word by merging, the earliest merge first, its places from left to right."""
    parts = list(word)
    for a, b in merges:
        i = 0
        while i < len(parts) - 1:
            if parts[i] == a and parts[i + 1] == b:
                parts[i : i + 2] = [a + b]
            i += 1
    return parts


def test_the_whole_table_of_small_vocabularies():
    """The states compiled from gadgets against the table built by adding one gadget after the other, and against merging."""
    for seed in range(30):
        rng = random.Random(seed)
        vocab, merges = {c: i for i, c in enumerate("abc")}, []
        for _ in range(rng.randint(1, 14)):
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                merges.append((a, b))
        auto = bpe.Automaton(vocab, merges, {})
        # rows are states: the first one, then the one after each arc
        n = len(vocab)
        table = np.zeros((n + 1, n), bool)
        table[:4, :3] = True
        for a, b in merges:
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if table[u + 1, v]:
                copy = table[v + 1].copy()
                copy[w] = copy[u]
                table[u + 1, v] = False  # before the new arcs: in aaa the first two merge
                table[:, w] = table[:, u]  # arcs uv beside arcs u; they lead to a copy of the state after v
                table[w + 1] = copy
        reached = [x for x in range(n) if table[0, x]]
        assert reached == sorted(i for label, i in vocab.items() if merged(merges, label) == [label])
        for x in reached:
            assert [y for y in reached if auto.has(x, y)] == [y for y in reached if table[x + 1, y]], (seed, x)
        names = {i: t for t, i in vocab.items()}
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            assert [names[i] for i in auto.encode(word)] == merged(merges, word), (merges, word)


def test_long_words_and_tables_that_are_emptied(monkeypatch):
    from tokenizers import Tokenizer

    auto, other = bpe.Automaton.read(bpe.vocabulary()), Tokenizer.from_file(bpe.vocabulary())
    monkeypatch.setattr(bpe, "TRANSITIONS", 50)
    monkeypatch.setattr(bpe, "PART", 1000)
    rng = random.Random(5)
    for text in ("ab" * 3000, "".join(rng.choice("abcdefgh ") for _ in range(9000)), "x " * 800 + "y" * 3000 + " z", "é" * 2000 + "\n" + " " * 3000):
        assert auto.encode(text) == other.encode(text, add_special_tokens=False).ids


def test_memory_of_a_worker_that_encodes():
    """What the tables of characters, and a state with its transitions, take while and after they are made."""
    auto = bpe.Automaton.read(bpe.vocabulary())
    auto.encode("a")
    rng = random.Random(6)
    words = " ".join("".join(rng.choice("abcdefghinorstu") for _ in range(rng.randint(3, 9))) for _ in range(6000))
    tracemalloc.start()
    try:
        bpe._kinds.__wrapped__()
        assert tracemalloc.get_traced_memory()[1] < 40e6
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        auto._start()
        auto.known.clear()
        auto.encode(words)
        auto.known.clear()
        assert len(auto.states) > 5000
        taken = tracemalloc.get_traced_memory()[0] - before - auto.slots.nbytes - auto.last.nbytes
        assert taken / len(auto.states) < 180
    finally:
        tracemalloc.stop()
    # all states and transitions of a full table, some pairs known
    assert bpe.TRANSITIONS // 2 * 250 + bpe.TRANSITIONS * 2 * 8 + bpe.TRANSITIONS // 4 * 120 < 100e6


@pytest.mark.parametrize("block", [16, 1 << 18])
def test_token_counts(spark, block):
    auto = bpe.Automaton.read(bpe.vocabulary())
    docs = [*ODD, *corpus(30)]
    got = sorted((r.doc_id or -1, r.n_tokens) for r in token_counts.document_token_counts(frame(spark, docs).repartition(3), block=block).collect())
    assert got == sorted((i or -1, len(auto.encode(t or "", special=False))) for i, t in docs)
    assert token_counts.document_token_counts(frame(spark, [])).count() == 0


def test_scan_of_real_files(spark, tmp_path):
    for name, ids in (("a.bin", [1, 2, 9, 9, 3]), ("b.bin", [9]), ("c.bin", [4] * 25 + [9])):
        np.array(ids, "<u2").tofile(tmp_path / name)
    (tmp_path / "d.bin").touch()
    files = token_counts.files_under(spark, str(tmp_path)).withColumn("n", F.lit(1)).withColumn("places", F.lit(2))
    found = token_counts.scan(files.union(files), eod=9, block=8)
    by = {}
    for r in found.orderBy("file", "first_document").collect():
        by.setdefault(r.file[-5:], []).extend(r.lengths)
    assert by == {"a.bin": [2, 0, 1], "b.bin": [0], "c.bin": [25]}


def test_leaks(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "Tiny item"), (3, None), (4, "...")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    docs = [(1, "x ZETA eta, theta iota kappa then alpha beta gamma delta epsilon y"), (2, "alpha beta gamma delta other epsilon"), (3, "a tiny item here"), (4, None), (None, items[0][1]), (5, items[0][1])]
    got = {(r.doc_id, r.item_id): (r.coverage, r.n_tiles) for r in decontaminate.leaks(frame(spark, docs), bench).collect()}
    assert got == {(1, 1): (1.0, 2), (3, 2): (1.0, 1), (5, 1): (1.0, 1)}
    assert decontaminate.leaks(frame(spark, []), bench).count() == 0 == decontaminate.leaks(frame(spark, docs), bench.limit(0)).count()


def test_tiles_mark_the_longest_first():
    doc, item = np.array([1, 2, 3, 4, 5, 6, 7, 1, 2, 3], np.uint64), np.array([1, 2, 3, 9, 2, 3, 4, 5, 6, 7], np.uint64)
    assert decontaminate.tiles(doc, item, 3) == [(1, 4, 6), (7, 0, 3)]


def brute_tiles(doc, item, seed):
    used, covered, out = [False] * len(doc), [False] * len(item), []
    seed = min(seed, len(item))
    while True:
        best, most = [], seed
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and not used[i + k] and not covered[j + k]:
                    k += 1
                if k > most:
                    best, most = [], k
                if k == most:
                    best.append((i, j))
        if not best or not seed:
            return out
        for i, j in best:
            if not any(used[i : i + most]) and not any(covered[j : j + most]):
                used[i : i + most] = [True] * most
                covered[j : j + most] = [True] * most
                out.append((i, j, most))


def test_tiles_against_brute_force():
    for seed in range(300):
        rng = random.Random(seed)
        letters = rng.randint(1, 5)
        doc, item = ([rng.randrange(letters) for _ in range(rng.randint(0, 40))] for _ in range(2))
        if seed % 3 == 0 and len(item) > 10:
            doc += item[5:] + item[:5]
        assert decontaminate.tiles(np.array(doc, np.int64), np.array(item, np.int64), 3) == brute_tiles(doc, item, 3), seed


def test_tiles_of_periodic_texts_take_little_memory():
    import time
    import tracemalloc

    same, pairs = np.zeros(200_000, np.int64), np.arange(20_000) % 2
    tracemalloc.start()
    start = time.process_time()
    assert decontaminate.tiles(same, same[:20_000]) == [(0, 0, 20_000)]
    assert sum(k for _, _, k in decontaminate.tiles(pairs, np.concatenate([pairs[:999], [7], pairs[:2000]]))) == 2999
    assert time.process_time() - start < 20 and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    items = [(i % 13, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 30)))) for i in range(15)]
    docs = []
    for i in range(60):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(0, 2)):
            passage = rng.choice(items)[1].split()
            at = rng.randrange(len(passage))
            words += passage[at:] + ["and"] + passage[:at]
        docs.append((i % 55, ", ".join(words).title()))
    want = {}
    for i, t in docs:
        for j, u in items:
            ours, theirs = t.lower().replace(",", "").split(), u.split()
            sizes = [k for _, _, k in brute_tiles(ours, theirs, 5)]
            if 2 * sum(sizes) >= len(theirs):
                want[i, j] = max(want.get((i, j), (0,)), (sum(sizes) / len(theirs), len(sizes), max(sizes)))
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.n_tiles, r.longest) for r in decontaminate.leaks(frame(spark, docs), bench).collect()}
    assert got == want and len(got) > 20


def test_quality(spark):
    rng = random.Random(0)
    words = ["the", "river", "house", "green", "walks", "slowly", "under", "bright", "old", "trees"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(60)) if i % 2 else "$$$ ### " * 30 + str(i)) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, 0, "t") for i in range(300)] + [(7, None, 0, "t")], "doc_id long, quality int, toxic int, text string")
    rows = quality.quality(frame(spark, [*docs, *ODD]), labels).collect()
    assert len(rows) == 300 + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    apart = [r for r in rows if r.held_out and r.doc_id > 6]
    assert sum(r.predicted == r.doc_id % 2 for r in apart) >= 0.95 * len(apart)
    flat = quality.quality(frame(spark, ODD), labels.limit(0))
    assert {r.score for r in flat.collect()} == {0.5} and quality.quality(frame(spark, []), labels).count() == 0


def plain_statistics(t):
    """The statistics of quality, word by word."""
    b = t.encode()
    low = lambda s: bytes(c + 32 if 65 <= c < 91 else c for c in s)
    words, lines = [low(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", b)], [low(x) for x in b.split(b"\n") if x]
    n, size = len(words), max(1, len(b))
    count = lambda chars: sum(c in chars for c in b)
    letters = count(range(65, 91)) + count(range(97, 123))
    kept = set(range(48, 58)) | set(range(65, 91)) | set(range(97, 123)) | set(b".,;:'\"-()?")
    pairs = list(zip(words, words[1:], strict=False))
    return [
        n, (size - count(b" ")) / max(1, n), count(range(65, 91)) / max(1, letters), sum(33 <= c < 127 and c not in kept for c in b) / size, count(b".,;:?!") / max(1, n), count(range(48, 58)) / size, count(range(128, 256)) / size,
        len(set(words)) / max(1, n), max(map(words.count, set(words)), default=0) / max(1, n), len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), count(b"|") / max(1, n), 1 - len(set(pairs)) / len(pairs) if pairs else 0,
    ]


def test_quality_rules_against_plain_versions(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(9)
    texts = ["", " \n ", "A b | c? 12 é\n\nA b", "x" * 60_000, "word " * 40_000] + ["".join(rng.choice("ab AB.,;|1é\n ###") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    rows = quality.statistics(frame(spark, list(enumerate(texts))).select(F.col("doc_id").alias("id"), "text")).collect()
    for r in rows:
        assert np.allclose(list(r)[1:], plain_statistics(texts[r.id])), texts[r.id][:50]
    data = spark.createDataFrame([(*[float(x) for x in list(r)[1:]], float(r.id % 2 or r.upper > 0.4)) for r in rows], [*quality.STATISTICS, "label"])
    packed = VectorAssembler(inputCols=quality.STATISTICS, outputCol="features").transform(data)
    forest = RandomForestClassifier(numTrees=5, maxDepth=3, seed=1).fit(packed)
    rules = quality.tree_rules(forest.toDebugString)

    def paths(node, above):
        """Every path from the root of a fitted tree, by its nodes."""
        if node.numDescendants() == 0:
            return
        name, bound = quality.STATISTICS[node.split().featureIndex()], node.split().threshold()
        for child, sign in ((node.leftChild(), "<="), (node.rightChild(), ">")):
            here = above | {(name, sign, bound)}
            yield tuple(sorted(here))
            yield from paths(child, here)

    assert rules == {x for tree in forest._call_java("trees") for x in paths(tree.rootNode(), frozenset())} and len(rules) > 10
    weights = {r: rng.uniform(-2, 2) for r in rules}
    scored = data.withColumn("score", quality.RuleEnsemble(0.3, weights).score()).collect()
    for r in scored:
        total = 0.3 + sum(w for rule, w in weights.items() if all(r[n] <= b if s == "<=" else r[n] > b for n, s, b in rule))
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9


@pytest.mark.parametrize("run", [3, 100_000])
def test_shards_of_equal_rows_in_runs(spark, monkeypatch, run):
    monkeypatch.setattr(sharding, "RUN", run)
    rows = sharding.shards(frame(spark, [(1, "abcdefghij")] * 37 + [(2, "x" * 31), (2, "x" * 31)]), 30).collect()
    size = {}
    for r in rows:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
    assert len(rows) == 39 and max(n for s, n in size.items() if not s.endswith("own")) <= 30 and sum(not r.fits for r in rows) == 2


def test_recall_of_near_duplicates(spark):
    """Ids divisible by 20 against all rows: how many of their links stay within a component."""
    rng = random.Random(11)
    docs = corpus(400, 7)
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(9000 if i > 57 else rng.randint(20, 200))]
        docs.append((1000 + 20 * i, " ".join(words)))
        for _ in range(rng.randint(1, max(1, len(words) // 45))):
            words[rng.randrange(len(words))] = "other"
        docs.append((1001 + 20 * i, " ".join(words)))
    sets = {}
    for i, t in docs:
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))}
    of = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, docs)).collect()}
    links = [(a, b) for a in sets if a % 20 == 0 for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) > 50 and sum(of[a] == of[b] for a, b in links) >= 0.9 * len(links)
    assert of[2180] == of[2181] != of[2160]


def test_shards(spark):
    docs = [*corpus(80), (900, "q" * 3000), *[(901, "same row of text")] * 40, *ODD]
    rows = sharding.shards(frame(spark, docs), 200).collect()
    assert len(rows) == len(docs)
    size = {}
    for r in rows:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
        assert r.fits == (r.n_bytes <= 200)
    assert all(n <= 200 for s, n in size.items() if not s.endswith("-own"))
    one = {r.shard for r in sharding.shards(frame(spark, docs), 10**9).collect()}
    assert one == {"0-0"} and sharding.shards(frame(spark, []), 10).count() == 0


def test_images():
    rng = np.random.default_rng(3)
    grey = rng.integers(0, 256, (13, 10)).astype(np.uint8)
    colour = rng.integers(0, 256, (6, 5, 3)).astype(np.uint8)
    assert np.array_equal(media.decode(media.encode_pgm(grey)), grey)
    assert np.array_equal(media.decode(media.encode_bmp(colour)), colour)
    assert np.array_equal(media.decode(b"P6 # c\n5 6\n255\n" + colour.tobytes()), colour)
    assert media.decode(b"P1\n# x\n3 1\n1 0 1").tolist() == [[0, 255, 0]] == media.decode(b"P4\n3 1\n\xa0").tolist()
    assert media.decode(b"P2 2 1 300\n1 299").tolist() == [[1, 299]]
    assert np.allclose(media.area_resize(np.kron(grey[:8, :9], np.ones((5, 4))), 8, 9), grey[:8, :9])
    step = media.STRIP
    media.STRIP = 7
    strips = media.area_resize(grey, 5, 3)
    media.STRIP = step
    assert np.allclose(strips, media.area_resize(grey, 5, 3)) and abs(strips.mean() - grey.mean()) < 1e-9
    assert np.array_equal(np.load(io.BytesIO(media.npy(media.tile(grey)))), media.tile(grey))


def test_media_columns(spark):
    rows = media.stored_payloads(frame(spark, ODD)).collect()
    want = []
    for i, t in ODD:
        b = (t or "").encode()
        payload = b + b"\0" * (max(1, -(-len(b) // 64)) * 64 - len(b))
        want.append((i, len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    got = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    images = [b"P5 2 2 255\n\1", None, b"", b"GIF", b"P2 1 1 255 300", b"P3 1 1 255 1 -1 2", b"P5 99999999999999999999 9 255\n\1", b"P2 1 1 0 0", b"P2 1 1 99999 1", b"BM" + b"\0" * 20, media.encode_bmp(np.zeros((2, 2, 3), np.uint8))[:60]]
    broken = spark.createDataFrame([(1, b if b is None else bytearray(b), "t") for b in images], "dhash long, tile binary, n string")
    found = media.image_features(broken, "tile").collect()
    assert len(found) == len(images) and all(r.error and r.tile is None and r.dhash is None and r.n == "t" for r in found)
    fine = spark.createDataFrame([(bytearray(b"P2 2 1 510 0 510"),)], "image binary")
    assert np.load(io.BytesIO(media.image_features(fine, "image", 1, 2).first().tile)).tolist() == [[0, 255]]
    assert media.stored_payloads(frame(spark, [])).count() == 0


def plain_cells(pixels, height, width):
    """Means over the cells of a grid, pixel by pixel, in fractions."""
    h, w = len(pixels), len(pixels[0])
    share = lambda i, cell, n, cells: max(0, min(i + 1, F_(cell + 1) * n / cells) - max(i, F_(cell) * n / cells))
    return [[float(sum(share(i, a, h, height) * share(j, b, w, width) * F_(pixels[i][j]) for i in range(h) for j in range(w)) / (F_(h, height) * F_(w, width))) for b in range(width)] for a in range(height)]


def test_features_of_stored_images_pixel_by_pixel(spark):
    docs = [(1, "abc"), (2, "x" * 64 * 2 + "Zz9"), (3, "The quick brown fox. " * 20), (4, "é" * 100), (5, None)]
    assert {len((t or "").encode() or b"x") // -64 % 3 == 0 for _, t in docs} == {True, False}
    for r in media.stored_payloads(frame(spark, docs)).collect():
        payload = (dict(docs)[r.doc_id] or "").encode().ljust(r.payload_bytes, b"\0")
        rows = r.payload_bytes // 64
        if rows % 3:
            pixels = [list(payload[64 * i : 64 * i + 64]) for i in range(rows)]
        else:
            pixels = [[sum(F_(f, 1000) * payload[192 * i + 3 * j + c] for c, f in enumerate((299, 587, 114))) for j in range(64)] for i in range(rows // 3)]
        tile = np.load(io.BytesIO(r.tile))
        assert np.abs(tile - np.array(plain_cells(pixels, 8, 9))).max() < 0.5 + 1e-6
        bits = "".join(str(int(tile[a][b + 1] > tile[a][b])) for a in range(8) for b in range(8))
        assert r.feature == f"{int(bits, 2):016x}:{hashlib.sha256(r.tile).hexdigest()[:16]}"


def test_urls(spark):
    urls = ["https://WWW.Example.com/en/1?q", "http://a.example.com/en/", "http://b.org/x", "http://x.net/fr/2#t", "http://net/es/", "http://mynet/es/", None, "no scheme/com/", "http://com", "ftp://u@c.com:8/?p"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[0], "h")], "page_id long, url string, host string")
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got[0] == got[None] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1][2:] == ("example.com/en/", "block") and got[2][2:] == (None, "allow") and got[3][2:] == ("net/fr/", "block")
    assert got[4][2:] == ("net/es/", "block") and got[5][2:] == (None, "allow") and got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("com", "", None, "allow") and got[9][:2] == ("u@c.com:8", "/")
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}
    long = "http://" + "a." * 300_000 + "example.com/en/" + "x/" * 50_000
    odd = spark.createDataFrame([(1, long, 1), (1, long, 1), (2, "", 1), (2, None, 1)], "page_id long, url string, rule long")
    got = sorted((r.page_id, r.rule, len(r.path)) for r in url_filter.judge(odd, rules).collect() if r.host)
    assert got == [(1, "example.com/en/", 100_004)] * 2 and url_filter.judge(odd.limit(0), rules).count() == 0


def test_digest_collisions_are_told_apart(tmp_path):
    name = url_filter.write_digests([("block", "a", "/"), ("allow", "b", "/")], str(tmp_path))
    array = url_filter.DigestArray(str(tmp_path), name)
    keys = [b"a\0/", b"zzz", b"b\0/"]
    hashes = np.array([array.digests[0], array.digests[0], array.digests[1]])
    order = [array.string(0), array.string(1)]
    assert array.find([order[0], b"zzz", order[1]], hashes).tolist() == [0, -1, 1] and set(order) == {keys[0], keys[2]}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="b1"><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="main"><div class="post p12"><h1>Head &amp; tail</h1><p>First <b>para</b>&nbsp;one<br>two <p>Second
 line<script>var a="</p>";</script><div class="ad">Buy</div><ul><li>item one<li>item two</ul></div>
<div class="comments"><p>A reader says a very long thing that goes on and on and on</p></div></div><aside>Side</aside><form>F<input></form><footer>&copy; x</footer>"""


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "http://h/1", PAGE, "z"), (2, "http://h/2", None, "z"), (3, None, "", "z"), (None, "http://h/3", "just text &lt;", "z"), (4, "http://h/4", "<p>" * 5000 + "deep", "z")], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html_extract.main_text(pages).collect()}
    assert got[1].text.split("\n") == ["Head & tail", "First para one two", "Second line", "item one", "item two"]
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == "" and got[None].text == "just text <" and got[4].text == "deep"
    assert html_extract.main_text(pages.limit(0)).count() == 0


LONG = "".join(f"<p>Sentence {i} of a story that goes on for quite some time.</p>" for i in range(20))
NAV = "<nav><a href=/>Home</a></nav>"


def own_text(page):
    return html_extract.extract(page, [])


def test_main_text_keeps_what_stands_around_the_largest_container():
    links = "<div class=more>" + "".join(f"<p><a href=/{i}>Another story, number {i}</a></p>" for i in range(20)) + "</div>"
    outside = ["<h1>Title</h1><p>lead</p>", "<section><p>Short section</p></section>", "<ul><li>point</ul>", "<blockquote>said</blockquote>", "<table><tr><td>7</table>"]
    for part in ("div class=body", "section", "ul", "table", "blockquote"):
        inner = f"<{part}>{LONG}</{part.split()[0]}>"
        for some in outside:
            page = f"<body>{NAV}<article>{some}{inner}<p>the end</p></article>{links}</body>"
            text = own_text(page)
            assert all(x in text for x in re.findall(">([^<>]+)", some))
            assert "Sentence 19" in text and "the end" in text and "Home" not in text and "Another" not in text


def test_main_text_keeps_the_outer_text_where_other_pages_of_the_host_have_none(spark):
    flat = f"<body><article><div class=body>{LONG}</div></article></body>"
    outer = f"<body><article><h1>Title</h1>{LONG}<div class=body><p>rest</p></div></article></body>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", flat) for i in range(5)] + [(9, "http://h/9", outer)], "page_id long, url string, html string")
    text = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}[9]
    assert text.startswith("Title") and "Sentence 19" in text and text.endswith("rest")


def test_main_text_in_wrappers_with_names_of_boilerplate():
    comments = "<div class=comments><article class=comment>" + "<p>A reader says so and so</p>" * 100 + "</article></div>"
    inner = f"<h1>Title</h1>{LONG}"
    wraps = [f"<div class='container has-sidebar'>{inner}</div>", f"<article class='post tag-search'>{inner}</article>", f"<main class='content with-comments'>{inner}</main>", f"<div id='menu-open'><article>{inner}</article></div>", f"<div class='page sidebar'><div class=search>{inner}</div></div>", f"<article class='story comments-open'>{inner}</article>"]
    for wrap in wraps:
        for page in (f"<body>{NAV}<div class=cookie>We use them</div>{wrap}{comments}</body>", f"<body>{wrap}<div class=sidebar>Side</div></body>"):
            text = own_text(page)
            assert text.startswith("Title") and "Sentence 19" in text, wrap
            assert not any(x in text for x in ("reader", "Home", "We use", "Side")), wrap
    assert own_text("<body><div class=cookie-notice>We use cookies</div></body>") == ""


def test_main_text_where_names_are_inline_or_a_form_holds_all():
    code = f"<body>{NAV}<article>{LONG}<p>see <span class=hljs-comment># a remark</span> and <span class=share>a share</span></p></article></body>"
    assert "see # a remark and a share" in own_text(code)
    page = f"<body><form action=/><div class=x>{LONG}<label>Name</label><input></div></form></body>"
    assert "Sentence 19" in own_text(page) and "Name" not in own_text(page)
    assert own_text(f"<body><header><div>{NAV}<article>{LONG}</article></div></body>").startswith("Sentence 0")
    for junk in ("<div class=ad>Buy this</div>", "<form><p>Your name please</p></form>", "<header><p>A blog</p></header>", "<footer>Imprint and such</footer>"):
        assert own_text(f"<body>{NAV}{junk}<article></article></body>") == ""
        assert own_text(f"<body>{NAV}{junk}<article><p>Short</p></article></body>") == "Short"


def test_main_text_of_a_page_that_only_the_vote_gets_right(spark):
    teasers = "<div class=more>" + "".join(f"<p>Another story {i} that is told elsewhere, <a href=/{i}>read it there</a></p>" for i in range(30)) + "</div>"
    usual, short = f"<body><div class=story>{LONG}</div></body>", f"<body><div class=story><p>Only a line.</p></div>{teasers}</body>"
    other = f"<body><main><p>Not the usual path.</p></main>{teasers}</body>"
    assert "Another" in own_text(short)
    pages = spark.createDataFrame([(i, f"http://h/{i}", usual) for i in range(5)] + [(9, "http://h/9", short), (9, "http://h/9", short), (10, "http://h/x", other), (11, "http://alone/", usual)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    assert got[9] == "Only a line." and got[10] == own_text(other) and got[11] == got[0]


def test_hostile_pages_are_read_in_a_moment():
    import time

    deep = "<div>x" * 100_000
    pages = ["<a " * 300_000, deep, "<i>" * 100_000 + "<p>" + "</b>" * 100_000, "<b>" + "<div>" * 50_000 + "</b>" * 50_000, "<!--" * 100_000, "<!" * 300_000, '<a b="' * 100_000, "<ul>" + "<li><div>" * 50_000, "</" * 200_000, "<a =' " * 100_000, "<script>" * 100_000, "<p>" * 200_000 + "deep"]
    start = time.process_time()
    texts = [own_text(p) for p in pages]
    assert time.process_time() - start < 20
    assert texts[1] == "\n".join("x" * 100_000) and texts[-1] == "deep"


def plain_blocks(page):
    """The blocks of all text outside of elements that never hold main text, by a parser of the standard library."""
    from html.parser import HTMLParser

    class Parser(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.text, self.off = [], [], 0

        def flush(self):
            joined = " ".join("".join(self.text).split())
            self.text = []
            if joined:
                self.out.append(joined)

        def handle_starttag(self, tag, attrs):
            if tag in html_extract.BLOCK:
                self.flush()
            self.off += tag in html_extract.ASIDE
            if tag == "br":
                self.text.append(" ")

        def handle_endtag(self, tag):
            if tag in html_extract.BLOCK:
                self.flush()
            self.off -= tag in html_extract.ASIDE

        def handle_data(self, data):
            if not self.off:
                self.text.append(data)

    parser = Parser()
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.out


def test_blocks_against_another_parser():
    for seed in range(300):
        rng = random.Random(seed)

        def node(depth, rng=rng):
            kind = rng.choice(["p", "div", "section", "ul", "b", "a", "text", "text", "nav", "script", "br", "comment", "h2", "table"])
            inner = lambda: "".join(node(depth - 1) for _ in range(rng.randint(0, 3))) if depth else rng.choice(["x", "y &amp; z", " "])
            words = rng.choice(["one two", " &lt;three&gt; ", "four\n five", "&eacute;", "a < b"])
            if kind in ("text", "br", "comment", "script"):
                return {"text": words, "br": "<br>", "comment": "<!-- <p>no</p> -->", "script": '<script>if (a<b) "</p>"</script>'}[kind]
            if kind in ("p", "h2", "b", "a"):
                return f"<{kind} title='> it'>{words}</{kind}>"
            if kind == "ul":
                return "<ul>" + "".join(f"<li>{inner()}</li>" for _ in range(2)) + "</ul>"
            if kind == "table":
                return f"<table><tr><td>{inner()}</td><td>{words}</td></tr></table>"
            return f"<{kind} class=c{seed}>{inner()}</{kind}>"

        page = "<body>" + "".join(node(4) for _ in range(4)) + "</body>"
        assert [t for _, t, _ in html_extract.Page(page).blocks] == plain_blocks(page), page


def test_pipeline(spark, tmp_path):
    """Each stage, on what the one before kept, against a plain version of it."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = corpus(40)
    rows = [(i, t, "en", "s", len(t)) for i, t in docs] + [(500, "### $$$ " * 40, "en", "s", 320), (501, None, None, None, None), (None, "no id", "en", "s", 5), (None, "no id", "en", "s", 5), (None, None, None, None, None)]
    rows += [(0, *rows[[i for i, _ in docs].index(0)][1:])]
    items = [(1, " ".join(f"q{i}" for i in range(24))), (2, "a passage that nobody has")]
    rows += [(700, f"{docs[1][1]} Q12 {' '.join(f'q{i}' for i in range(13, 24))}, {' '.join(f'q{i}' for i in range(12))} and {docs[2][1][:50]}", "en", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in docs] + [(500 + 2 * i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "repeats", "decontamination", "tokens"] and corpus_pipeline.ORACLE_SQL is None
    text = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    good = stages["quality"](spark, given, str(tmp_path)).cache()
    scores = {r.doc_id: r.predicted for r in quality.quality(given, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert text(good) == sorted([(r[0], r[1]) for r in rows if r[0] is None or scores[r[0]]], key=str)

    once = stages["near_dedup"](spark, good, str(tmp_path)).cache()
    left = {(r.doc_id, r.text) for r in good.collect()}
    of, _ = brute_components([(i, t or "") for i, t in left if i is not None], 5, 80)
    assert text(once) == sorted([(i, t) for i, t in left if i is None or of[i] == i], key=str)

    cut = stages["repeats"](spark, once, str(tmp_path)).cache()
    brute = brute_repeats([(r.doc_id, r.text or "") for r in once.where("doc_id is not null").collect()])
    assert {r.doc_id: len((r.text or "").encode()) for r in cut.where("doc_id is not null").collect()} == {i: n - gone for i, (n, gone, _, _) in brute.items() if n - gone or not n}
    assert cut.where("coalesce(length(text), 0) <> n_chars").isEmpty()

    clean = stages["decontamination"](spark, cut, str(tmp_path)).cache()

    def leaks(t):
        words = lambda s: re.findall(r"[a-z0-9]+", s.lower())
        return any(2 * sum(k for _, _, k in brute_tiles(words(t), words(u), 5)) >= len(words(u)) for _, u in items)

    assert text(clean) == [(i, t) for i, t in text(cut) if i is None or not leaks(t or "")] and 700 in {i for i, _ in text(cut)} - {i for i, _ in text(clean)}
    assert good.columns == once.columns == cut.columns == clean.columns == given.columns

    other = Tokenizer.from_file(bpe.vocabulary())
    want = sorted(((i, len(other.encode(t or "", add_special_tokens=False).ids)) for i, t in text(clean)), key=str)
    assert sorted(((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == want
