"""Operator 10: main text of web pages by paths that a host's pages agree on.

First pass: each page's containers are scored by the text that stands in them, and the page votes for the generalised
path (tags and classes, digits levelled) of its best one. Spark counts the votes by host. Second pass: a page's text is
taken from all elements on the first of its host's winning paths that it has, or from its own best container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import workspace, written
from .url_rules import host_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CONTAINERS = frozenset("article body center dd div main section td".split())
#: Elements that hold no main text, and words that say the same of a block: a class all of whose words are among these
#: (cookie-notice, but not ad-hoc), or so an id of a div that no article holds, as ids of others are made of headings.
OUTSIDE = frozenset("aside button canvas footer form head header iframe menu nav noscript object script select style svg template textarea title".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer"
    " gdpr header login masthead menu nav navbar navigation newsletter notice notices pagination popup promo promoted recommended related"
    " respond share sharing sidebar signup social sponsor sponsored subscribe topbar widget widgets".split()
)
OUTSIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Blocks that a class or role can put outside; headings, paragraphs, items, cells and quotes are text whatever they are called.
BLOCKS = frozenset("center details dialog div dl fieldset figure ol section table ul".split())
#: Start tags that end an open element: the open one ends unless a tag that holds it in lies between.
P_ENDED, P_HELD = ("p",), ("table", "button", *sorted(CONTAINERS - {"body"}))
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: Comments and declarations, then a tag without quotes, then a tag's name.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^<>"']*)>""")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: What decides on a tag's end: a > ends it, a quote after = holds it open up to the next such quote.
STOP = re.compile(r"""=\s*+(["'])|>""")
#: A tag whose quotes don't close ends at the next > or <.
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)(?:>|(?=<)|\Z)")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def aside(name: str) -> bool:
    """Whether a class or id says that its block isn't main text: all of its words do."""
    said = [w for w in re.split(r"[^a-z]+", name) if w]
    return bool(said) and OUTSIDE_WORDS.issuperset(said)


class TagEnds:
    """Where tags with quotes end. What was looked for in vain is remembered, so all tags of a page together take time in
    proportion to it: each quote is followed at most once in vain, and each stretch without a quote or > is read once."""

    def __init__(self, source: str):
        self.source, self.vain, self.last = source, set(), (0, None)
        self.no_more = {'"': len(source) + 1, "'": len(source) + 1}

    def stop(self, at: int) -> re.Match | None:
        """The first > or quote from `at` on."""
        since, m = self.last
        if m is None and since and at >= since or m is not None and since <= at <= m.start():
            return m
        self.last = (at, STOP.search(self.source, at))
        return self.last[1]

    def after(self, at: int) -> int:
        """The place after the > that ends the tag whose attributes begin at `at`; 0 if a quote or the tag isn't closed."""
        followed = []
        while m := self.stop(at):
            if not m[1]:
                return m.end()
            if m.end() in self.vain or m.end() >= self.no_more[m[1]]:
                break
            followed.append(m.end())
            close = self.source.find(m[1], m.end())
            if close < 0:
                self.no_more[m[1]] = m.end()
                break
            at = close + 1
        self.vain.update(followed)
        return 0


class Page:
    """A page's elements (parent, key, path number, nearest container, whether outside the main text) and its text chunks
    (element, text); a chunk of None is the edge of a block. Reading takes time in proportion to the page, however deep
    elements are nested: the places of open elements are kept by tag, and paths are numbered."""

    def __init__(self, source: str | None):
        self.parents, self.keys, self.tags, self.outside = [-1], [""], [""], [False]
        self.paths, self.containers, self.links = [0], [0], [False]
        self.numbers: dict[tuple[int, str], int] = {}
        self.chunks: list[tuple[int, str | None]] = []
        #: Open elements, and the places in it of each tag and of those that aren't inline.
        self.stack, self.places, self.blocks = [0], {}, [0]
        self._read(source or "")

    def _read(self, source: str) -> None:
        at, seek, end, ends = 0, 0, len(source), TagEnds(source)
        while (lt := source.find("<", seek)) >= 0:
            m, rest, stop = TAG.match(source, lt), None, 0
            if m is None and (m := MARKUP.match(source, lt)) is None and (m := NAME.match(source, lt)):
                if stop := ends.after(m.end()):
                    rest = source[m.end() : stop - 1]
                else:
                    m = LOOSE.match(source, lt)
            if m is None:
                seek = lt + 1
                continue
            if lt > at:
                self._text(source[at:lt])
            at = stop or m.end()
            if m.lastindex:
                closing, tag = m[1], m[2].lower()
                if closing:
                    self._close(tag)
                else:
                    self._open(tag, m[3] if rest is None else rest)
                    if tag in RAW:
                        close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                        at = close.start() if close else end
            seek = at
        if at < end:
            self._text(source[at:])

    def _text(self, text: str) -> None:
        if not self.outside[self.stack[-1]]:
            self.chunks.append((self.stack[-1], html.unescape(text) if "&" in text else text))

    def _edge(self) -> None:
        self.chunks.append((self.stack[-1], None))

    def _last(self, tags: Iterable[str]) -> int:
        """The highest place of an open element with one of these tags; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _cut(self, place: int) -> None:
        """Close all open elements from a place on."""
        for node in self.stack[place:]:
            self.places[self.tags[node]].pop()
        while self.blocks[-1] >= place:
            self.blocks.pop()
        del self.stack[place:]

    def _open(self, tag: str, rest: str) -> None:
        if tag not in INLINE:
            self._end_open(P_ENDED, P_HELD)
            self._edge()
        if tag in ENDS:
            self._end_open(*ENDS[tag])
        if tag in VOID:
            return
        names: dict[str, str] = {}
        if "=" in rest:
            for m in ATTRIBUTE.finditer(rest):
                names.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        parent = self.stack[-1]
        kinds = sorted({re.sub(r"\d+", "#", c) for c in names.get("class", "").lower().replace(">", "").split()})
        outside = self.outside[parent] or tag in OUTSIDE
        if not outside and names and tag in BLOCKS:
            said = names.get("class", "").lower().split()
            if tag == "div" and not self.places.get("article"):
                said += names.get("id", "").lower().split()
            outside = any(map(aside, said)) or names.get("role", "").lower() in OUTSIDE_ROLES
        key, node = ".".join((tag, *kinds)), len(self.parents)
        self.parents.append(parent)
        self.keys.append(key)
        self.tags.append(tag)
        self.paths.append(self.numbers.setdefault((self.paths[parent], key), len(self.numbers) + 1))
        self.containers.append(node if tag in CONTAINERS else self.containers[parent])
        self.outside.append(outside)
        self.links.append(self.links[parent] or tag == "a")
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def _end_open(self, ended: Iterable[str], held: Iterable[str]) -> None:
        place = self._last(ended)
        if place and place > self._last(held):
            self._cut(place)

    def _close(self, tag: str) -> None:
        place = self._last((tag,))
        if tag in ("body", "html") or not place or tag in INLINE and self.blocks[-1] > place:
            return
        if tag not in INLINE:
            self._edge()
        self._cut(place)
        if tag not in INLINE:
            self._edge()

    def path(self, node: int) -> str:
        keys = []
        while node > 0:
            keys.append(self.keys[node])
            node = self.parents[node]
        return ">".join(reversed(keys))

    def number(self, path: str) -> int:
        """The number of a path; -1 if the page has none such."""
        at = 0
        for key in path.split(">"):
            at = self.numbers.get((at, key), -1)
        return at

    def best(self) -> tuple[int, float]:
        """The container with the highest score (0, the page, where there is no text). Text counts in full for the nearest
        container and less and less for those around it; links count against. Of nested ones that are articles or mains,
        the outermost stands for all."""
        scores: dict[int, float] = {}
        for node, text in self.chunks:
            n = len(text.strip()) if text else 0
            if not n:
                continue
            gain, up = -0.5 * n if self.links[node] else float(n), self.containers[node]
            while up > 0 and gain:
                scores[up] = scores.get(up, 0.0) + gain
                gain = gain * 0.4 if abs(gain) > 1e-3 else 0
                up = self.containers[self.parents[up]]
        if not scores:
            return 0, 0.0
        node = max(scores, key=lambda k: (scores[k], -k))
        score, up = scores[node], node
        while up > 0:
            if self.tags[up] in ("article", "main"):
                node = up
            up = self.parents[up]
        return node, score

    def text(self, paths: list[str]) -> str:
        """The text of all elements on the first path that the page has, or of its best container."""
        roots: set[int] = set()
        if paths:
            by_path: dict[int, list[int]] = {}
            for node in range(1, len(self.keys)):
                if not self.outside[node]:
                    by_path.setdefault(self.paths[node], []).append(node)
            roots = set(next((by_path[n] for n in map(self.number, paths) if n in by_path), ()))
        if not roots:
            roots = {self.best()[0]}
        inside = [False] * len(self.parents)
        out = []
        for node in range(len(self.parents)):  # parents come before their children
            inside[node] = node in roots or (node > 0 and inside[self.parents[node]])
        for node, text in self.chunks:
            if inside[node]:
                out.append(" " if text is None else text)
        return " ".join("".join(out).split())


def votes(pages: DataFrame) -> DataFrame:
    """host, path, n: how many pages of each host have their best container on each path."""

    def vote(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hosts, paths = [], []
            for host, source in zip(part.column("host").to_pylist(), part.column("html"), strict=True):
                page = Page(source.as_py())
                node, score = page.best()
                if score > 0:
                    hosts.append(host)
                    paths.append(page.path(node))
            yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "path": pa.array(paths, pa.string())})

    rows = pages.select(host_of(F.col("url")).alias("host"), "html").where("host <> ''")
    return rows.mapInArrow(vote, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("n"))


def winners(counted: DataFrame, share: float = 0.1) -> DataFrame:
    """host and `paths`: those with at least `share` of the host's votes, most votes first, ties by path."""
    total = counted.groupBy("host").agg(F.sum("n").alias("all"))
    good = counted.join(total, "host").where(F.col("n") >= share * F.col("all"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "path")))
    return good.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def extracted(pages: DataFrame, folder: str | None = None, share: float = 0.1) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html).

    Null or empty html gives an empty text; a page without a host has no consensus and uses its own best container;
    repeated rows are extracted each; more columns are ignored; an empty table gives an empty result.
    """
    folder = folder or workspace(pages.sparkSession, "html")
    paths = written(winners(votes(pages), share), folder, "paths")

    def extract(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [Page(s.as_py()).text(p.as_py() or []) for s, p in zip(part.column("html"), part.column("paths"), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host_of(F.col("url")).alias("host")).join(paths, "host", "left")
    texts = rows.select("page_id", "url", "html", "paths").mapInArrow(extract, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
