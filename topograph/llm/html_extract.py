"""Operator 3: main text of web pages by the paths that a host's pages agree on.

Every page is read once to score its containers: the length of the text
blocks in a container, less what is linked, and less as the blocks lie deeper.
From the best one it climbs to the outermost container that adds hardly any
links. The path of tags and classes to that, generalised so that numbers and
the like don't count, is the page's vote. Spark sums the votes of each host.
Then each page is read again and the text comes from the path with the most
votes that the page has.

Reading looks at every character a bounded number of times: the open elements
are also listed by tag, and paths are numbered nodes of a tree.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.functions.scratch import materialize
from topograph.llm.url_filter import host_of

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = set("article main section div body td center blockquote form ul ol table figure".split())
#: Elements that never hold main text.
ASIDE = set("head nav footer aside script style noscript template iframe svg canvas audio video object select option textarea input menu dialog map title".split())
#: Fixed words: a block's class, id or role that consists of the first, and of the last at most, says as a whole that it isn't main text; of the second, that it may not be.
STRICT_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments respond disqus cookie cookies consent gdpr notice notices popup modal overlay pagination pager toolbar complementary contentinfo".split())
#: Of the first, those that no page's main text stands in.
NEVER_WORDS = set("ad ads advert adverts advertisement advertising comment comments respond disqus cookie cookies consent gdpr".split())
LOOSE_WORDS = set("banner header masthead share sharing social related recommended newsletter subscribe signup login alert widget search".split())
FILL_WORDS = set("site page main top bottom left right box block container wrapper wrap list area section bar links link posts articles form slot unit inner outer item items global primary secondary first second third js policy message user reader thread col column".split())
#: A class of these beside such a name says the opposite.
CONTENT_WORDS = set("content article post entry story text body main".split())
#: What a container's text counts when it is looked for: names lower it, they don't rule it out.
WEIGHT = {"": 1.0, "list": 1.0, "header": 0.5, "loose": 0.5, "form": 0.3, "strict": 0.02, "never": 0.0}
_SPLIT = re.compile(r"[^a-z]+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_END = re.compile(r">|=\s*(?:\"[^\"]*\"|'[^']*')")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
#: p ends where a block begins; these end at a sibling of their kind.
_ENDS = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"], "option": ["option"]}
_SCOPE = {"li": ["ul", "ol", "menu"], "dt": ["dl"], "dd": ["dl"], "tr": ["table"], "td": ["table", "tr"], "th": ["table", "tr"], "option": ["select"]}


class _Named:
    """An element whose names, or tag, say that it may not be main text.

    owner is the one around it, path the container it is or, if it is none, the
    one around it; own and linked count the characters in it.
    """

    __slots__ = ("article", "container", "holds", "kind", "linked", "own", "owner", "path")

    def __init__(self, owner: int, kind: str, path: int, container: bool, article: bool):
        self.owner, self.kind, self.path, self.container, self.article = owner, kind, path, container, article
        self.own = self.linked = 0
        self.holds = False


def _kind(names: list[str], classes: list[str]) -> str:
    """never, strict or loose if one of the names, as a whole, says that a block isn't main text or may not be."""
    if any(c in CONTENT_WORDS for c in classes):
        strict: set[str] = set()
        loose = STRICT_WORDS | LOOSE_WORDS
    else:
        strict, loose = STRICT_WORDS, LOOSE_WORDS
    kind = ""
    for name in names:
        words = [w for w in _SPLIT.split(name) if w]
        if words and all(w in STRICT_WORDS or w in LOOSE_WORDS or w in FILL_WORDS for w in words):
            if not strict.isdisjoint(words):
                kind = "never" if kind == "never" or not NEVER_WORDS.isdisjoint(words) else "strict"
            elif not kind and not loose.isdisjoint(words):
                kind = "loose"
    return kind


def _step(tag: str, attributes: str) -> tuple[str, str, bool]:
    """A step of a generalised path, what the names say, and whether it is hidden."""
    given: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        given.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    classes = given.get("class", "").split()
    kind = ""
    if tag in BLOCK and tag not in ("html", "body", "main", "article"):
        kind = _kind([*classes, *given.get("id", "").split(), *given.get("role", "").split()], classes)
    hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in "".join(given.get("style", "").split())
    return ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in classes})]), kind, hidden


class Page:
    """The blocks of main text of a page, in order, and the paths of the containers around them as a tree."""

    def __init__(self, page: str):
        self.parent, self.steps, self.numbers = [0], [""], {}
        #: (path, text, linked characters)
        self.blocks: list[tuple[int, str, int]] = []
        self.named = [_Named(0, "", 0, True, False)]
        self.found = list(self._read(page, self.named))
        for e in reversed(self.named[1:]):  # elements come before those within
            self.named[e.owner].own += e.own
            self.named[e.owner].linked += e.linked
            self.named[e.owner].holds |= e.holds and e.kind != "never"
        weights = [1.0]
        for e in self.named[1:]:
            weights.append(min(weights[e.owner], WEIGHT[e.kind] if self._may_hold(e) else 0.0))
        n = len(self.parent)
        self.scores = [0.0] * n
        for path, text, linked, owner in self.found:
            self.scores[path] += max(0.0, len(text) - 2.0 * linked) * weights[owner]
        for k in range(n - 1, 0, -1):  # a path comes before those within
            self.scores[self.parent[k]] += 0.85 * self.scores[k]
        self.top = max(range(n), key=lambda k: (self.scores[k] if k else 0.0, -k))
        self.blocks = self.kept(self.top, menus=False)
        self.chars, self.links = [0] * n, [0] * n
        for path, text, linked in self.blocks:
            self.chars[path] += len(text)
            self.links[path] += min(linked, len(text))
        for k in range(n - 1, 0, -1):
            self.chars[self.parent[k]] += self.chars[k]
            self.links[self.parent[k]] += self.links[k]

    def _may_hold(self, e: _Named) -> bool:
        """Whether a named element may be around the main text: not by a name of never, nor a form or the like where the page has an article elsewhere."""
        return e.kind in ("loose", "list", "header") or e.kind != "never" and (e.holds or e.article or not self.named[0].holds)

    def kept(self, top: int, menus: bool = True) -> list[tuple[int, str, int]]:
        """The blocks that are main text if the container at top is what holds it; with menus, lists of links on a page are looked for too.

        What stands around top, or is it, stays if its name allows. Of the rest
        go elements named strictly, forms, headers that are not part of an
        article or of top, elements named loosely but those that have most of
        the page's text or stand within an article or top, if they aren't mostly
        links, and on a page without such a container lists that are links alone.
        """
        around, k = {top}, top
        while k:
            k = self.parent[k]
            around.add(k)
        within = [False] * len(self.parent)
        page = top == 0 or self.steps[top].split(".")[0] in ("html", "body")
        if not page:
            for k in range(1, len(within)):
                within[k] = k == top or within[self.parent[k]]
        gone = [False]
        unlinked = self.named[0].own - self.named[0].linked - sum(e.own - e.linked for e in self.named[1:] if e.kind == "never")
        for e in self.named[1:]:
            part = e.article or within[e.path]
            if e.container and e.path in around and self._may_hold(e):
                drop = False
            elif e.kind == "header":
                drop = not (part or e.holds)
            elif e.kind == "loose":
                most = 2 * (e.own - e.linked) > unlinked  # more than all else on the page
                drop = not (part or e.holds or most) or 2 * e.linked > e.own
            elif e.kind == "list":
                drop = menus and not part and 0 < e.own <= e.linked
            else:
                drop = True
            gone.append(drop or gone[e.owner])
        return [(path, text, linked) for path, text, linked, owner in self.found if not gone[owner]]

    def _read(self, page: str, named: list[_Named]) -> Iterator[tuple[int, str, int, int]]:
        """(path, text, linked characters, named element) of each block; all elements with names of boilerplate are added to named."""
        # tag, path, named element around it, whether its text never counts, whether it is linked
        open_: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]
        where: dict[str, list[int]] = {}
        block_at: list[int] = [0]
        text: list[str] = []
        linked = at = pos = 0
        n = len(page)

        def flush() -> Iterator[tuple[int, str, int, int]]:
            nonlocal linked
            if text:
                joined = " ".join(html.unescape("".join(text)).split())
                text.clear()
                if joined:
                    _, path, owner, _, _ = open_[-1]
                    yield path, joined, linked, owner
            linked = 0

        def add(some: str) -> None:
            nonlocal linked
            _, _, owner, never, link = open_[-1]
            if some and not never:
                text.append(some)
                size = len(some.strip())
                named[owner].own += size
                if link:
                    linked += len(some)
                    named[owner].linked += size

        def close(upto: int) -> None:
            while len(open_) > upto:
                tag = open_.pop()[0]
                where[tag].pop()
            while block_at[-1] >= upto:
                block_at.pop()

        def last(tags: list[str]) -> int:
            return max(where[t][-1] if where.get(t) else 0 for t in tags)

        while True:
            lt = page.find("<", pos)
            if lt < 0:
                break
            c = page[lt + 1 : lt + 2]
            ending = c == "/"
            name = _NAME.match(page, lt + 2 if ending else lt + 1)
            if name is None:
                if c not in ("!", "?", "/") or not c:
                    pos = lt + 1
                    continue
                add(page[at:lt])  # a comment or the like
                mark = "-->" if page.startswith("<!--", lt) else ">"
                end = page.find(mark, lt + 2)
                at = pos = end + len(mark) if end >= 0 else n
                continue
            end = name.end()
            found = _END.search(page, end)
            while found and found[0] != ">":
                found = _END.search(page, found.end())
            add(page[at:lt])
            if found is None:  # the page ends within a tag
                at = n
                break
            attributes = page[end : found.start()]
            at = pos = found.end()
            tag = name[0].lower()
            block = tag in BLOCK
            if ending:
                i = where[tag][-1] if where.get(tag) else 0
                if block:
                    if i or tag == "p":
                        yield from flush()
                    if i:
                        close(i)
                elif i > block_at[-1]:  # an inline end tag closes no block
                    close(i)
                continue
            if tag == "br":
                add(" ")
                continue
            if block:
                yield from flush()
                if open_[block_at[-1]][0] == "p":
                    close(block_at[-1])
                if tag in _ENDS:
                    while (i := last(_ENDS[tag])) > last(_SCOPE[tag]):
                        close(i)
                        if tag != "tr":
                            break
            if tag in VOID:
                continue
            step, kind, hidden = _step(tag, attributes) if attributes else (tag, "", False)
            _, path, owner, never, link = open_[-1]
            never = never or tag in ASIDE or hidden or tag in ("button", "label") and bool(where.get("form"))
            if tag in RAW:
                stop = _RAW_END[tag].search(page, pos)
                if stop is None:
                    at = n
                    break
                close_at = page.find(">", stop.end())
                at = pos = close_at + 1 if close_at >= 0 else n
                continue
            if attributes.rstrip().endswith("/") and not block:
                continue
            if tag in CONTAINER or tag == "html":
                key = path, step
                path = self.numbers.get(key, 0)
                if not path:
                    path = self.numbers[key] = len(self.steps)
                    self.steps.append(step)
                    self.parent.append(key[0])
            kind = tag if tag in ("form", "header") and kind not in ("strict", "never") else kind or ("list" if tag in ("ul", "ol") else "")
            if kind and not never:
                article = bool(where.get("article") or where.get("main"))
                named.append(_Named(owner, kind, path, tag in CONTAINER, article))
                owner = len(named) - 1
            if tag in ("article", "main") and not never:
                named[owner].holds = True
            if block:
                block_at.append(len(open_))
            where.setdefault(tag, []).append(len(open_))
            open_.append((tag, path, owner, never, link or tag == "a"))
        add(page[at:])
        yield from flush()

    def best(self) -> int:
        """The container around the most own text, and what stands around it; 0, the page, where there is none."""
        return self.outer(self.top)

    def outer(self, path: int) -> int:
        """The outermost container of path whose other text is mostly unlinked, with few links beside all it holds."""
        best, at = path, self.parent[path]
        while at:
            added, linked = self.chars[at] - self.chars[path], self.links[at] - self.links[path]
            if self.chars[at] > self.chars[best] and 2 * linked <= added and 10 * linked <= self.chars[at]:
                best = at
            at = self.parent[at]
        return best

    def name(self, path: int) -> str:
        """The steps to a path, parted by spaces."""
        out = []
        while path:
            out.append(self.steps[path])
            path = self.parent[path]
        return " ".join(reversed(out))

    def find(self, name: str) -> int:
        """The path of that name if the page has text there, else 0."""
        at = 0
        for step in name.split(" "):
            at = self.numbers.get((at, step), 0)
            if not at:
                return 0
        return at if self.chars[at] else 0

    def text(self, path: int, top: int | None = None) -> str:
        """The blocks in a container, in the page if path is 0, that are main text if top holds it."""
        inside = [path == 0] * len(self.parent)
        for k in range(1, len(inside)):
            inside[k] = k == path or inside[self.parent[k]]
        blocks = self.kept(self.top if top is None else top)
        return "\n".join(text for p, text, _ in blocks if inside[p])


def votes(page: str) -> list[tuple[str, float]]:
    """(path, score) of the container around the most own text; none for a page without text."""
    read = Page(page)
    best = read.best()
    return [(read.name(best), read.scores[best])] if best else []


def extract(page: str, wanted: list[str]) -> str:
    """The blocks around the first of the wanted paths that the page has text at; around its own best one if it has none of them."""
    read = Page(page)
    path = next((p for p in map(read.find, wanted) if p), 0)
    return read.text(read.outer(path), path) if path else read.text(read.best())


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.05) -> DataFrame:
    """(id_col, url_col, text, n_chars) for every row of pages.

    A null or empty page, or one without main text, has an empty text; an
    empty table gives no rows. Pages without a host vote together. Paths with
    at least share of a host's votes stand for it, the most voted first; ties
    go to the lesser path. A page that has none of them uses its own best one.
    Rows that repeat vote and are read each; pages of any length are read in
    time and memory in proportion; other columns play no part.
    """
    given = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = [], [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                for path, score in votes(page.as_py()):
                    for x, y in zip(out, (host, path, score), strict=True):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.float64()), strict=True)], ["host", "path", "score"])

    cast = given.select("host", "html").mapInArrow(vote, "host string, path string, score double")
    counted = materialize(cast.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("score", 3)).alias("score")), "votes")
    total = counted.groupBy("host").agg(F.sum("n").alias("all"))
    # at most 1 / share paths for each host
    strong = counted.join(total, "host").where(F.col("n") >= share * F.col("all"))
    winners = strong.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))), lambda x: x["path"]).alias("paths"))

    winners = materialize(winners, "winners")  # so that a join may split the pages of one host

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, paths in zip(batch.column("html"), batch.column("paths").to_pylist(), strict=True):
                texts.append(extract(page.as_py(), paths or []))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    joined = given.join(winners, "host", "left").select("id", "url", "html", "paths")
    return joined.mapInArrow(read, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
