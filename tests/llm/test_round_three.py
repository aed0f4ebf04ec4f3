"""Periodic runs, BPE by a queue of ranks and hard negatives against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from topograph.llm import html_extract, negatives, periods, rank_bpe

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (None, "no id at all"), (5, "Ünï <|endoftext|> 漢字 🙂"), (5, "another text"), (6, "word " * 3000), (7, "x" * 5000)]
SCHEMA = "doc_id long, text string, id string, ids string, runs long, words string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, "z", 2) for i, t in rows], SCHEMA)


def brute_runs(w, least=1):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - a + q
            x = w[a : a + length]
            if length >= max(2 * q, least) and not any(x[r:] == x[:-r] for r in range(1, q)):
                out.append((a, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digests(doc_id, text, plant):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(w)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = [r for r in brute_runs(w, 6) if r[1] >= 4 * r[2]]
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for a, length, q in found for i in range(a + q, a + length)}
    lines = "".join(f"{a},{length},{q}\n" for a, length, q in found)
    left = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def some_words(rng):
    n, k = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(k) for _ in range(n)]
    if n > 5 and rng.random() < 0.5:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 2))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_square_catchers():
    """Any cut of the words into calls gives all maximal runs."""
    rng = random.Random(5)
    for t in range(600):
        w = some_words(rng)
        c = periods.SquareCatchers()
        i = 0
        while i < len(w):
            m = (len(w), 1, rng.randint(1, 9))[t % 3]
            c.append(np.array(w[i : i + m], np.int64))
            i += m
        assert [tuple(r) for r in c.runs().tolist()] == brute_runs(w)


def test_catchers_say_what_stands_so_far():
    c = periods.SquareCatchers()
    c.append(np.array([7, 1, 2, 1, 2]))
    assert c.runs().tolist() == [[1, 4, 2]]
    c.append(np.array([1, 2, 9]))
    assert c.runs().tolist() == [[1, 6, 2]]


def test_catchers_on_hard_texts():
    """One word, a Fibonacci word and a long period, without quadratic work; borders part texts."""
    c = periods.SquareCatchers()
    c.append(np.zeros(200_000, np.int64))
    assert c.runs().tolist() == [[0, 200_000, 1]]
    x, y = [0], [0, 1]
    while len(y) < 900:
        x, y = y, y + x
    c = periods.SquareCatchers()
    c.append(np.array(y[:300]))
    assert [tuple(r) for r in c.runs().tolist()] == brute_runs(y[:300])
    block = np.random.default_rng(1).permutation(7001)
    c = periods.SquareCatchers(most=7001)
    c.append(np.concatenate([np.tile(block, 5), [-1], np.tile(block, 2)]))
    assert c.runs().tolist() == [[0, 35005, 7001], [35006, 14002, 7001]]


def test_op11(spark):
    rng = random.Random(8)
    docs = ODD + [(i, " ".join(map(str, some_words(rng)))) for i in range(100, 300)] + [(i, " ".join(rng.choice("abcd") for _ in range(40)) + "\tq" * 9) for i in range(300, 340)]
    given = frame(spark, docs)
    for plant in (True, False):
        rows = periods.run_digests(periods.periodic_runs(periods.planted(given) if plant else given)).collect()
        key = lambda r: str(tuple(r))
        assert sorted(map(tuple, rows), key=key) == sorted((brute_digests(i, t, plant) for i, t in docs), key=key)
    assert any(r["n_runs"] > 1 for r in rows) and any(r["n_runs"] == 0 for r in rows)
    assert periods.periodic_runs(given.limit(0)).count() == 0
    whole = {r["doc_id"]: r for r in periods.periodic_runs(given).collect() if r["doc_id"] in (3, 6)}
    assert whole[6]["collapsed"] == "word" and whole[6]["n_words"] == 3000 and whole[6]["runs"][0].asDict() == {"start": 0, "length": 3000, "period": 1}
    assert whole[3]["collapsed"] == "" and whole[3]["runs"] == []


@pytest.fixture(scope="module")
def ranks():
    return rank_bpe.Ranks.read(rank_bpe.vocabulary())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})


def lists(ids, ends):
    ids = ids.tolist()
    return [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


def test_rank_queue_pops_in_order():
    rng = random.Random(2)
    queue, all_ = rank_bpe.RankQueue(300_000), {}
    for _ in range(50):
        for _ in range(rng.randint(0, 20)):
            rank, at = rng.randrange(300_000), rng.randrange(100)
            queue.push(rank, np.array([at]))
            all_.setdefault(rank, set()).add(at)
        for _ in range(rng.randint(0, 15)):
            least = queue.pop()
            if least is None:
                assert not all_
            else:
                assert least[0] == min(all_) and least[1].tolist() == sorted(all_.pop(least[0]))


def test_pieces_like_the_library(ranks, library):
    rng = random.Random(3)
    pieces = [bytes(rng.randrange(256) for _ in range(rng.randint(1, 60))) for _ in range(500)] + [rng.choice([b"a", b"ab", b"ing", b"ngi", b" ", "é".encode()]) * rng.randint(1, 300) for _ in range(300)]
    assert lists(*ranks.encode(pieces)) == [library._core_bpe.encode_single_piece(p) for p in pieces]
    assert lists(*ranks.encode([b"", b"a", b""])) == [[], [ranks.ranks[b"a"]], []]


def test_texts_like_the_library(ranks, library):
    letters = "aaaab bcd'se \n\t.,!éü漢字🙂 　019 \x1c"
    rng = random.Random(4)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["a" * 100_000, "ab" * 80_000, "漢" * 30_000, "".join(rng.choice("abcdefghij") for _ in range(100_000)), " " * 50_000 + "x"]
    found = [x for ids, ends in rank_bpe.encode_texts(texts, ranks, regex.compile(public_tokenizers.PATTERN)) for x in lists(ids, ends)]
    assert found == [library.encode_ordinary(t) for t in texts]


def plain_merges(piece, table):
    if piece in table:
        return [table[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((table[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in table), default=None)
        if best is None:
            return [table[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_tables_whose_longer_tokens_come_first():
    """Ranks in any order: a merge may bring about a pair of a smaller rank, which then goes first."""
    rng = random.Random(6)
    for _ in range(60):
        tokens = {bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 6))) for _ in range(25)}
        order = [bytes([b]) for b in range(256)] + sorted(tokens)
        rng.shuffle(order)
        table = {t: 3 * i for i, t in enumerate(order)}
        ranks = rank_bpe.Ranks(table)
        pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(40)]
        assert lists(*ranks.encode(pieces)) == [plain_merges(p, table) for p in pieces]
        back, sizes = ranks.decode(np.concatenate([np.array(plain_merges(p, table)) for p in pieces]))
        assert back.tobytes() == b"".join(pieces) and len(sizes)
    with pytest.raises(ValueError, match="not in the table"):
        ranks.decode(np.array([1]))
    with pytest.raises(ValueError, match="single byte"):
        rank_bpe.Ranks({b"a": 0})


def test_op12(spark, library):
    rng = random.Random(9)
    docs = ODD + [(i, "".join(rng.choice("ab cdé\n'st") for _ in range(rng.randint(0, 200)))) for i in range(50)] + [(99, "xyz " * 300_000)]
    given = frame(spark, docs)
    rows = [tuple(r) for r in rank_bpe.digests(given).collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in docs:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode_bytes(ids))))
    key = lambda r: str(r)
    assert sorted(rows, key=key) == sorted(want, key=key)
    assert rank_bpe.digests(given.limit(0)).count() == 0
    ids = spark.createDataFrame([(1, None), (2, []), (3, [ord("a")])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: bytes(r["decoded"]) for r in rank_bpe.decode(ids).collect()} == {1: b"", 2: b"", 3: library.decode_bytes([ord("a")])}


def brute_negatives(rows, scale=256):
    kept = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            row = (i, tuple(math.floor(scale * float(np.float32(x))) for x in v), label)
            if row not in kept:
                kept.append(row)
    out = []
    for a in [r for r in kept if r[0] % 100 == 0]:
        scored = sorted(((-sum(x * y for x, y in zip(a[1], r[1], strict=False)), r[0], r[2]) for r in kept if r != a))
        for ps, p, _ in [s for s in scored if s[2] == a[2]][:5]:
            near = [s for s in scored if s[2] != a[2] and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:5]
            out += [(a[0], p, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(near, 1)]
    return sorted(out)


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    return [(i, [float(x) for x in (centres[i % 6] + rng.normal(size=d) * 0.4) * 0.3], int(rng.integers(0, 4))) for i in range(n)]


KIND = "vec_id long, embedding array<float>, label int, rid long, score long, norm string"


def as_frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "x") for i, v, label in rows], KIND)


@pytest.mark.parametrize("d", [8, 64, 100])
def test_op13(spark, monkeypatch, d):
    """Copies, ties, nulls, ragged and zero vectors, repeated ids; in blocks of a few rows."""
    monkeypatch.setattr(negatives, "ROWS", 70)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    monkeypatch.setattr(negatives, "PAIRS", 64)
    rows = vectors(410, d, d)
    same = rows[100][1]
    rows += [(1000 + i, same, i % 4) for i in range(40)] + [(rows[0])] * 3 + [(200, rows[7][1], 2), (203, rows[8][1], 2), (500, [0.0] * d, 1), (501, same[:3], 1)]
    rows += [(600, None, 1), (700, same, None), (800, [None] + same[1:], 1), (900, [float("nan")] + same[1:], 1), (901, [float("inf")] + same[1:], 1), (None, same, 1)]
    got = sorted(map(tuple, negatives.hard_negatives(as_frame(spark, rows)).collect()))
    assert got == brute_negatives(rows) and len(got) > 30


def test_op13_edges(spark):
    assert negatives.hard_negatives(as_frame(spark, []).limit(0)).count() == 0
    assert negatives.hard_negatives(as_frame(spark, [(0, [1.0], 1)])).count() == 0
    assert negatives.hard_negatives(as_frame(spark, [(0, [], 1), (1, [], 1), (2, [], 2)])).collect() == [(0, 1, 1, 2, 0, 0)]
    huge = negatives.hard_negatives(as_frame(spark, [(0, [3e30, 1.0], 1), (1, [3e30, 1.0], 1), (2, [3e30, 0.0], 2)])).collect()
    assert huge == [(0, 1, 1, 2, (1 << 63) - 1, (1 << 63) - 1)]


def test_intervals_hold():
    """No inner product lies outside of its interval, and many intervals rule a row out."""
    rng = np.random.default_rng(3)
    for d in (64, 256):
        rows = np.floor(rng.normal(size=(400, d)) * rng.choice([1, 30, 4000], size=(400, 1))).astype(np.int64)
        rows[0] = 0
        asked = np.floor(rows[:20] + rng.normal(size=(20, d)) * 5).astype(np.int64)
        low, high = negatives.Planes(asked).intervals(*negatives.encode(rows))
        exact = asked @ rows.T
        assert (low <= exact).all() and (exact <= high).all()
        own = exact[np.arange(1, 20), np.arange(1, 20)]
        assert (high[1:] < 0.8 * own[:, None]).mean() > 0.2


STORY = "Long text of an article that goes on. " * 20


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ('<section class="related-work"><p>RW</p></section>', "RW"), ('<p class="footer-note">FN</p>', "FN"), ('<div class="ad-hoc">AH</div>', "AH"), ('<p class="subscribe">SU</p>', "SU"),
        ('<figure class="banner"><figcaption>FC</figcaption></figure>', "FC"), ('<div class="post-header"><h1>PH</h1></div>', "PH"), ("<header><h1>HH</h1><p>lead</p></header>", "HH\nlead"),
        ("<p>Press <button>OK</button> and <label>Name</label> now, <math>x</math></p>", "Press OK and Name now, x"), ('<ul><li><a href="/1">a source</a></li></ul>', "a source"),
        ('<div class="cookie-notice">N</div>', ""), ('<section id="comments"><p>C</p></section>', ""), ('<div class="comment-list"><p>C</p></div>', ""), ("<aside>A</aside><div class=ad-slot>B</div>", ""), ("<footer>F</footer>", ""), ("<form><p>F</p><button>Go</button></form>", ""),
        ('<ul class="share"><li><a>x</a></li></ul>', ""), ('<div class="left sidebar"><p>S</p></div>', ""),
    ],
)
def test_op3_names_inside_the_article(inner, want):
    """Only what as a whole is named boilerplate goes from an article, and what the contract lists."""
    page = f"<body><nav>menu</nav><article><p>{STORY}</p>{inner}<p>end {STORY}</p></article></body>"
    assert html_extract.extract(page, []) == "\n".join(x for x in (STORY.strip(), want, f"end {STORY}".strip()) if x)


@pytest.mark.parametrize("n", [1, 3, 60, 400])
def test_op3_no_size_decides(n):
    """The container that holds the most is kept whatever its name and its size."""
    text = " ".join(["word"] * n)
    for name in ("content share", "cookie-recipe", "search", "widget", "footer-note", "sidebar"):
        assert html_extract.extract(f'<body><nav>m</nav><div class="{name}"><p>{text}</p></div></body>', []) == text
    assert text in html_extract.extract(f'<body><div class="search">{text} and more</div><p>x</p></body>', [])
    assert html_extract.extract(f"<body><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul><p>{text}</p></body>", []) == text
    talk = "<p>A reader says much more than the page does</p>" * 50
    assert html_extract.extract(f"<body><div class=post><h1>T</h1><p>{text}</p></div><div class=comments>{talk}</div></body>", []) == f"T\n{text}"
