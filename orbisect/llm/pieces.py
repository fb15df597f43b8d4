"""Operator 6: SentencePiece encoding and decoding, giant documents in parallel chunks.

Encoding is a best path through the lattice of a text's pieces. In a unigram model a piece weighs its score. In a BPE
model a piece weighs nothing, but a step between two pieces is open only if BPE leaves the two as they are: a row of
pieces is the BPE encoding of its text if and only if each piece alone and each two neighbours are that of theirs, so
the one open path is the library's result. (Merges on both sides of a cut that is never merged don't see each other.)

A document above GIANT code points is cut in chunks. The state at a chunk's edge is the piece that lies across it or
ends at it. Each chunk yields the max-plus matrix of its best paths from entry to exit states; the matrices of a
document are combined in order, which fixes every edge's state; then each chunk is traced back on its own. Shorter
documents go to the library whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import workspace, written

GIANT, CHUNK = 65_536, 16_384
#: Chunks of giant documents that a task scans.
TASK_CHUNKS = 8
#: Pairs of pieces and words that a process keeps.
MEMO, WORDS = 150_000, 150_000
#: Fixed values of SentencePiece: piece types, model types, and what an unknown character costs a unigram path.
NORMAL, USER_DEFINED, UNUSED = 1, 4, 5
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


class Model:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.library.serialized_model_proto())
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("word and character models have no lattice")
        own = [(i, p) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED, UNUSED)]
        self.ids = {p.piece: i for i, p in own}
        self.scores = {p.piece: p.score for _, p in own}
        self.unknown_score = min(self.scores.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids))
        self.starts = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if proto.trainer_spec.byte_fallback else None
        # Whether spaces cut all merges: no piece holds a space after another character. A text begins with a space, too.
        apart = all("▁" not in p.lstrip("▁") for p in self.ids) and self.kind == BPE
        self.cut_by_space = apart and proto.normalizer_spec.name == "identity" and proto.normalizer_spec.add_dummy_prefix
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.memo: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}

    def bpe(self, text: str) -> list[str]:
        """A short text's BPE pieces: of all neighbours that join to a piece, the best score first, then the leftmost."""
        parts = list(text)
        while True:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def stands(self, piece: str) -> bool:
        if self.kind == UNIGRAM:
            return True
        if (known := self.alone.get(piece)) is None:
            known = self.alone[piece] = self.bpe(piece) == [piece]
        return known

    def open(self, a: str, b: str) -> bool:
        """Whether b may follow a."""
        if self.kind == UNIGRAM:
            return True
        if (known := self.memo.get((a, b))) is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            known = self.memo[a, b] = self.bpe(a + b) == [a, b]
        return known

    def weight(self, piece: str) -> float:
        return 0.0 if self.kind == BPE else self.scores.get(piece, self.unknown_score)

    def at(self, text: str, i: int) -> list[str]:
        """The pieces that begin at a place; a character of no piece is one of its own."""
        found = [text[i]]
        for j in range(i + 2, min(i + self.longest, len(text)) + 1):
            part = text[i:j]
            if part not in self.starts:
                break
            if part in self.ids and self.stands(part):
                found.append(part)
        return found

    def to_ids(self, pieces: Iterable[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode()]
            elif not out or out[-1] != self.library.unk_id():
                out.append(self.library.unk_id())
        return out


    def encode(self, texts: list[str]) -> pa.ListArray:
        """The library's ids of each text. Where spaces cut all merges, a word's ids don't depend on its neighbours, and each
        distinct word is encoded once; texts with spaces side by side or at an end go to the library whole."""
        plain = [bool(t) and self.cut_by_space and "  " not in t and t[0] != " " and t[-1] != " " and "▁" not in t for t in texts]
        own = [t for t, p in zip(texts, plain, strict=True) if p]
        flat, sizes = self.by_words(own) if own else (np.empty(0, np.int32), np.empty(0, np.int64))
        if len(own) == len(texts):
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        rest = iter(self.library.encode([t for t, p in zip(texts, plain, strict=True) if not p], num_threads=1))
        parts = iter(np.split(flat, np.cumsum(sizes)[:-1]) if own else [])
        return pa.array([next(parts if p else rest) for p in plain], pa.list_(pa.int32()))

    def by_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = split.offsets.to_numpy()
        codes = split.flatten().dictionary_encode()
        unique, index = codes.dictionary.to_pylist(), codes.indices.to_numpy()
        parts = self.look_up(unique)
        table = np.frombuffer(b"".join(parts), np.int32)
        size = np.array([len(p) // 4 for p in parts], np.int64)
        begin, n = np.cumsum(size) - size, size[index]
        ends = np.cumsum(n)
        flat = table[np.repeat(begin[index] - (ends - n), n) + np.arange(ends[-1])]
        return flat, np.diff(np.concatenate(([0], ends))[offsets])

    def look_up(self, keys: list[str]) -> list[bytes]:
        """Ids of words; of two generations of the memo the older goes when the newer is full."""
        missing = [k for k in keys if k not in self.words]
        fresh = [k for k in missing if k not in self.older]
        self.words.update((k, self.older[k]) for k in missing if k in self.older)
        for k, ids in zip(fresh, self.library.encode(fresh, num_threads=1), strict=True):
            self.words[k] = np.array(ids, np.int32).tobytes()
        parts = [self.words[k] for k in keys]
        if len(self.words) > WORDS:
            self.words, self.older = {}, self.words
        return parts


@cache
def model(path: str) -> Model:
    return Model(path)


@dataclass(frozen=True)
class Part:
    """A chunk [lo, hi) of a text, of which `text` is what it and the pieces across its edges need."""

    text: str
    lo: int
    hi: int

    def edge(self, m: Model, at: int) -> list[tuple[int, str]]:
        """The states at an edge: (start, piece) of pieces that hold the character before it. None stands for the text's
        beginning. Both chunks at an edge list the same states in the same order."""
        return [(s, p) for s in range(max(0, at - m.longest), at) for p in m.at(self.text, s) if s + len(p) >= at]


def cut(text: str, longest: int, chunk: int = CHUNK) -> Iterator[tuple[int, Part, int]]:
    """(number, part, of how many) of a normalised text."""
    n = -(-len(text) // chunk)
    for k in range(n):
        a, b = k * chunk, min(len(text), (k + 1) * chunk)
        left = max(0, a - 2 * longest)
        yield k, Part(text[left : min(len(text), b + longest)], a - left, b - left), n


NONE = float("-inf")


def lattice(m: Model, part: Part, entries: list[tuple[int, str] | None]) -> dict[int, list]:
    """Nodes by the place where they end: (piece, start, score from each entry as an array, or for BPE as a bit set)."""
    bits = m.kind == BPE
    ends: dict[int, list] = {}
    for k, e in enumerate(entries):
        if bits:
            value = 1 << k
        else:
            value = np.full(len(entries), NONE)
            value[k] = 0.0
        ends.setdefault(part.lo if e is None else e[0] + len(e[1]), []).append((None if e is None else e[1], -1 if e is None else e[0], value))
    memo, alone = m.memo, m.open
    for s in range(part.lo, part.hi):
        before = ends.get(s)
        if not before:
            continue
        for piece in m.at(part.text, s):
            if bits:
                value = 0
                for p, _, v in before:
                    if p is None or (known if (known := memo.get((p, piece))) is not None else alone(p, piece)):
                        value |= v
                if not value:
                    continue
            else:
                value = np.maximum.reduce([v for _, _, v in before]) + m.weight(piece)
            ends.setdefault(s + len(piece), []).append((piece, s, value))
    return ends


def entries_of(m: Model, part: Part, first: bool) -> list[tuple[int, str] | None]:
    return [None] if first else part.edge(m, part.lo)


def transfer(m: Model, part: Part, first: bool) -> np.ndarray:
    """The max-plus matrix of a chunk: best score from each entry state to each exit state; the weight of a piece counts
    where it begins."""
    entries = entries_of(m, part, first)
    exits = {e: k for k, e in enumerate(part.edge(m, part.hi))}
    out = np.full((len(entries), len(exits)), NONE)
    for nodes in lattice(m, part, entries).values():
        for piece, s, value in nodes:
            k = exits.get((s, piece))
            if k is None:
                continue
            if m.kind == BPE:
                for h in range(len(entries)):
                    if value >> h & 1:
                        out[h, k] = 0.0
            else:
                out[:, k] = np.maximum(out[:, k], value)
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus matrix product; associative."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1, initial=NONE)


def states(matrices: list[np.ndarray]) -> list[int]:
    """The state of the best path at each edge, from the first chunk's entry to the last one's exit. There is one entry, so
    what is combined is a row of scores, not whole products of matrices."""
    upto = [np.zeros((1, 1))]
    for t in matrices:
        upto.append(product(upto[-1], t))
    found = [int(np.argmax(upto[-1][0]))]
    for t, before in zip(reversed(matrices), reversed(upto[:-1]), strict=True):
        found.append(int(np.argmax(before[0] + t[:, found[-1]])))
    return found[::-1]


def traced(m: Model, part: Part, first: bool, entry: int, leaves: int) -> list[str]:
    """The pieces that begin in a chunk, on the best path between two states."""
    start = entries_of(m, part, first)[entry]
    ends = lattice(m, part, [start])
    s, piece = part.edge(m, part.hi)[leaves]
    out: list[str] = []
    score = lambda v: (0.0 if v else NONE) if m.kind == BPE else float(v[0])
    while (s, piece) != (start if start is not None else (-1, None)):
        if s < part.lo:
            raise RuntimeError("no path between these states")
        out.append(piece)
        ways = [(score(v), p, a) for p, a, v in ends[s] if p is None or m.open(p, piece)]
        _, piece, s = max(ways, key=lambda w: w[0])
    return out[::-1]


def encode_in_chunks(m: Model, text: str, chunk: int = CHUNK) -> list[int]:
    """What the Spark stages below do for one text, in one place."""
    parts = [(k, p) for k, p, _ in cut(m.library.normalize(text), m.longest, chunk)]
    if not parts:
        return []
    at = states([transfer(m, p, k == 0) for k, p in parts])
    return m.to_ids(x for k, p in parts for x in traced(m, p, k == 0, at[k], at[k + 1]))


ENCODED = "row long, k int, ids array<int>"


def giant_encoded(docs: DataFrame, path: str, folder: str, chunk: int = CHUNK) -> DataFrame:
    """row, k, ids: a row for each chunk."""

    def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column("row").to_pylist(), b.column("text"), strict=True):
                m = model(path)
                for k, p, n in cut(m.library.normalize(text.as_py()), m.longest, chunk):
                    yield pa.RecordBatch.from_pydict({"row": [row], "k": pa.array([k], pa.int32()), "n": pa.array([n], pa.int32()), "text": [p.text], "lo": pa.array([p.lo], pa.int32()), "hi": pa.array([p.hi], pa.int32())})

    def matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                t = transfer(model(path), Part(r["text"], r["lo"], r["hi"]), r["k"] == 0)
                yield pa.RecordBatch.from_pydict({"row": [r["row"]], "k": pa.array([r["k"]], pa.int32()), "wide": pa.array([t.shape[1]], pa.int32()), "t": [t.astype("<f8").tobytes()]})

    def combined(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        at = states([np.frombuffer(r["t"], "<f8").reshape(-1, r["wide"]) for r in rows])
        pick = lambda x: pa.array(x, pa.int32())
        return pa.table({"row": [r["row"] for r in rows], "k": pick([r["k"] for r in rows]), "entry": pick(at[:-1]), "leaves": pick(at[1:])})

    combined.__annotations__ = {"table": pa.Table, "return": pa.Table}

    def trace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                m = model(path)
                ids = m.to_ids(traced(m, Part(r["text"], r["lo"], r["hi"]), r["k"] == 0, r["entry"], r["leaves"]))
                yield pa.RecordBatch.from_arrays([pa.array([r["row"]]), pa.array([r["k"]], pa.int32()), pa.array([ids], pa.list_(pa.int32()))], ["row", "k", "ids"])

    parts = docs.select("row", "text").mapInArrow(slices, "row long, k int, n int, text string, lo int, hi int")
    parts = written(parts, folder, "chunks")
    # Chunks of one document go to many tasks: a given number of them, as the bytes are too few for Spark to choose so many.
    tasks = max(1, parts.count() // TASK_CHUNKS)
    found = written(parts.repartition(tasks, "row", "k").mapInArrow(matrices, "row long, k int, wide int, t binary"), folder, "matrices")
    edges = written(found.groupBy("row").applyInArrow(combined, "row long, k int, entry int, leaves int"), folder, "edges")
    return parts.join(edges, ["row", "k"]).repartition(tasks, "row", "k").mapInArrow(trace, ENCODED)


def encoded(docs: DataFrame, path: str, folder: str | None = None, giant: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """docs with `ids`, the SentencePiece ids of each text (null and empty texts have none); its text column goes.

    Every row is encoded by itself, so repeated rows come out as often; a column of docs named ids is replaced.
    """
    folder = folder or workspace(docs.sparkSession, "pieces")
    rest = [c for c in docs.columns if c not in ("text", "ids")]
    text = F.coalesce("text", F.lit(""))
    long = F.length(text) > (GIANT if giant is None else giant)
    named = docs.select(F.monotonically_increasing_id().alias("row"), text.alias("text"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"), long.alias("long"))
    return _joined(named, path, folder, chunk).select(*(F.col(f"rest.`{c}`").alias(c) for c in rest), "ids")


def _joined(named: DataFrame, path: str, folder: str, chunk: int) -> DataFrame:
    """Short documents never leave their task; giant ones are written with their number, and meet their ids by it."""
    schema = named.schema
    giants = written(named.where("long"), folder, "giants")
    of = giant_encoded(giants.select("row", "text"), path, folder, chunk)
    whole = of.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"]).alias("ids"))
    met = giants.select("row", "rest").join(whole, "row", "left").select("rest", F.flatten("ids").alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column("rest"), model(path).encode(part.column("text").to_pylist())], ["rest", "ids"])

    kind = schema["rest"].dataType.simpleString()
    short = named.where("NOT long").select("rest", "text").mapInArrow(run, f"rest {kind}, ids array<int>")
    return short.unionByName(met)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """rows with `text`, decoded from ids; null ids give an empty text; a column of rows named text is replaced."""
    rest = [c for c in rows.columns if c not in ("text", "ids")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                texts = model(path).library.decode([x or [] for x in part.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("rest"), part.column("ids"), pa.array(texts, pa.string())], ["rest", "ids", "text"])

    named = rows.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"), "ids")
    out = named.mapInArrow(run, f"rest {named.schema['rest'].dataType.simpleString()}, ids array<int>, text string")
    return out.select(*(F.col(f"rest.`{c}`").alias(c) for c in rest), "ids", "text")


def digested(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian uint32) and decoded_sha256 (hex, UTF-8) of each row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                n, crc, sha = [], [], []
                for ids in part.column("ids"):
                    own = ids.values.to_numpy() if ids.is_valid else np.empty(0, np.int32)
                    n.append(len(own))
                    crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                    sha.append(hashlib.sha256(model(path).library.decode(own.tolist()).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha)], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    rows = encoded(docs.select(F.col("doc_id").cast("long"), "text"), path, folder)
    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")
