"""Operator 5: URL rules by a bit-parallel automaton.

All glob rules are packed into one bit vector of several 64-bit words, a bit for each place of a rule that reads a
character. Extended Shift-And then runs every rule over a URL at once: the state shifts by one, keeps the bits whose
place reads the character, and holds places that a star loops on. A batch of URLs advances together, one character of
each a step, so a step costs a few numpy operations whatever the number of URLs.

Rules read the canonical URL ".host/path", whose host is lower-cased and has neither port rules nor query. `*` reads
anything, `~` reads anything but a slash (so it stays in the host), `?` reads one character.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER


@dataclass(frozen=True)
class Rule:
    """text: what is reported; glob: what it reads, or several of which any will do; verdict: allow or block. Of rules that
    fit, the longest text wins."""

    text: str
    glob: str | tuple[str, ...]
    verdict: str


def path_rule(text: str, verdict: str) -> Rule:
    """A rule like example.com/en/: it fits its host, all subdomains, and every path that starts with its path. Without a
    slash it fits all of their paths, the empty one too."""
    host, slash, path = text.partition("/")
    name = f"~.{host.lower()}"
    return Rule(text, f"{name}/{path}*" if slash else (name, f"{name}/*"), verdict)


class Automaton:
    """The masks of a rule set over UTF-8 bytes; match() returns the index of the winning rule of each text or -1."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = sorted(rules, key=lambda r: (len(r.text), r.text, r.verdict))
        places: list[tuple[list[bool], list[bool]]] = []  # what each place reads, what it loops on after it was reached
        begin, ends = [], []
        every, name = [True] * 256, [c != ord("/") for c in range(256)]
        later = [0x80 <= c < 0xC0 for c in range(256)]  # bytes that go on with a character
        globs = [(i, g) for i, r in enumerate(self.rules) for g in ([r.glob] if isinstance(r.glob, str) else r.glob)]
        for _, glob in globs:
            begin.append(len(places))
            reads: list[list[list[bool]]] = [[[False] * 256, [False] * 256]]  # the first place stands before the text
            for c in glob:
                if c in "*~":
                    loop = every if c == "*" else name
                    reads[-1][1] = [a or b for a, b in zip(reads[-1][1], loop, strict=True)]
                elif c == "?":
                    reads.append([[not x for x in later], later])
                else:
                    reads += [[[x == b for x in range(256)], [False] * 256] for b in c.encode()]
            places += [(a, b) for a, b in reads]
            ends.append(len(places) - 1)
        self.words = max(1, -(-len(places) // 64))
        self.reads, self.loops = (self.masks([p[k] for p in places]) for k in (0, 1))
        self.begin = self.bits(begin)
        self.ends = [(i, k // 64, np.uint64(1 << (k % 64))) for (i, _), k in zip(globs, ends, strict=True)]

    def bits(self, at: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in at:
            out[i // 64] |= np.uint64(1 << (i % 64))
        return out

    def masks(self, places: list[list[bool]]) -> np.ndarray:
        out = np.zeros((256, self.words), np.uint64)
        for i, reads in enumerate(places):
            out[np.flatnonzero(reads), i // 64] |= np.uint64(1 << (i % 64))
        return out

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Texts are run in order of their lengths, so a very long one costs steps of its own only."""
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        start = (np.cumsum(sizes) - sizes)[order]
        state = np.repeat(self.begin[None, :], len(texts), axis=0)
        sizes, live = sizes[order], len(texts)
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            while sizes[live - 1] <= step:
                live -= 1
            c, now = data[start[:live] + step], state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top  # a rule may lie across words
            state[:live] = (moved & self.reads[c]) | (now & self.loops[c])
        best = np.full(len(texts), -1)
        for i, word, bit in self.ends:  # in order of length: the longest is put last
            best[(state[:, word] & bit) != 0] = i
        out = np.empty_like(best)
        out[order] = best
        return out


@cache
def automaton(rules: tuple[Rule, ...]) -> Automaton:
    return Automaton(rules)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lowered; empty for null or where :// is missing."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, rules: tuple[Rule, ...], default: str = "allow", url: str = "url", chunk: int = 8192) -> DataFrame:
    """pages with host, path, rule and verdict: the longest rule that fits, or null and `default` where none does.

    Null urls have an empty host and path, which path rules don't fit. Repeated rows are judged alike; a column of
    pages named as one of the four results is replaced.
    """
    if bad := [r for r in rules if r.verdict not in ("allow", "block")]:
        raise ValueError(f"verdicts are allow or block: {bad}")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))

    def judge(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(rules)
        texts = [r.text for r in a.rules] + [None]
        verdicts = [r.verdict for r in a.rules] + [default]
        for part in parts:
            for i in range(0, part.num_rows, chunk):
                p = part.slice(i, chunk)
                urls = [f".{h}{t}".encode() for h, t in zip(p.column("host").to_pylist(), p.column("path").to_pylist(), strict=True)]
                best = a.match(urls).tolist()
                more = [pa.array([x[b] for b in best], pa.string()) for x in (texts, verdicts)]
                yield pa.RecordBatch.from_arrays([*p.columns, *more], [*p.schema.names, "rule", "verdict"])

    return rows.mapInArrow(judge, f"{ddl(rows)}, rule string, verdict string")


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
