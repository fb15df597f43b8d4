"""Operator 1: token ids in Simple-8b files.

A 64-bit word holds a selector in its upper 4 bits and as many ids of equal width as fit in the other 60.
Ids of 60 bits or more follow as a raw word after an escape, which is selector 15 with all payload bits set.
Ids are packed in blocks of BLOCK; the footer has each block's offset, so that blocks decode alone and a reader can
start anywhere. Packing and unpacking run over all blocks of a batch at once in numpy.

File: header, blocks, then doc ids (int64), their null flags (uint8), ids per document (int64), block offsets in words
(uint64, one more than blocks), and a trailer of five uint64: documents, blocks, ids, footer's place, magic number.
"""

from __future__ import annotations

import json
import struct
import sys
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, workspace, written

#: Fixed values of Simple-8b: ids per word and bits per id, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = (1 << 64) - 1
BLOCK = 1024
MAGIC = 0x3153423850495353
HEADER = struct.Struct("<QQ")
TRAILER = struct.Struct("<QQQQQ")
#: Blocks packed or unpacked at once, and characters encoded at once: they bound a task's memory.
GROUP, CHARS = 512, 4_000_000
END_ID = 1


def bit_lengths(values: np.ndarray) -> np.ndarray:
    if int(values.max(initial=0)) < 1 << 32:
        return np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    high = (values >> np.uint64(32)).astype(np.float64)
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The words of all blocks, and how many words each block has. Only the last block may be short."""
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    blocks, wide = -(-n // block), block + int(COUNTS[0])
    flat = np.zeros(blocks * block, np.uint64)
    flat[:n] = values
    grid = np.zeros((blocks, wide), np.uint64)  # zeros after each block, so that its last word can be filled up
    grid[:, :block] = flat.reshape(blocks, block)
    size = np.full(blocks, block)
    size[-1] = n - (blocks - 1) * block
    selector = selectors(bit_lengths(grid), block)
    # Each block's words begin where the last one's ids end: walk all blocks at once, then fill words by selector.
    at, rows, starts, owners = np.zeros(blocks, np.int64), np.arange(blocks), [], []
    while len(rows):
        starts.append(at[rows])
        owners.append(rows)
        at[rows] += COUNTS[selector[rows, at[rows]]]
        rows = rows[at[rows] < size[rows]]
    start, owner = np.concatenate(starts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    start, owner = start[order], owner[order]
    kind = selector[owner, start]
    word, first, flat = kind.astype(np.uint64) << np.uint64(60), owner * wide + start, grid.reshape(-1)
    for s in range(2, 16):
        here = np.flatnonzero(kind == s)
        if len(here):
            for i in range(int(COUNTS[s])):
                part = flat[first[here] + i]
                word[here] |= np.minimum(part, np.uint64((1 << 60) - 1)) << np.uint64(i * WIDTHS[s])
    raw = np.flatnonzero(word == np.uint64(ESCAPE))
    sizes = np.bincount(owner, minlength=blocks)
    if len(raw):
        word = np.insert(word, raw + 1, flat[first[raw]])
        sizes += np.bincount(owner[raw], minlength=blocks)
    return word, sizes


def selectors(bits: np.ndarray, block: int) -> np.ndarray:
    """The least selector (most ids a word) that holds the ids from each place on."""
    widest, k, best = {1: bits}, 1, np.full(bits.shape, 15, np.uint8)
    while k < 128:  # widest id of the next k, by doubling
        wider = widest[k].copy()
        np.maximum(wider[:, :-k], widest[k][:, k:], out=wider[:, :-k])
        k *= 2
        widest[k] = wider
    for s in range(14, -1, -1):
        want = int(COUNTS[s])
        part = 1 << (want.bit_length() - 1)
        over = widest[part].copy()
        if part < want:
            shift = want - part
            np.maximum(over[:, :-shift], widest[part][:, shift:], out=over[:, :-shift])
        if over[:, : max(1, block - want)].min() <= WIDTHS[s] or bits.shape[0] == 1:
            np.copyto(best, np.uint8(s), where=over <= WIDTHS[s])
    return best


def unpack(stream: np.ndarray, offsets: np.ndarray, total: int, block: int = BLOCK) -> np.ndarray:
    """The ids of whole blocks, whose words begin at offsets; total: how many ids they have."""
    raw = np.zeros(len(stream), bool)
    for i in np.flatnonzero(stream == np.uint64(ESCAPE)):
        if not raw[i]:
            raw[i + 1] = True
    selector = (stream >> np.uint64(60)).astype(np.int64)
    count = np.where(raw, 0, COUNTS[selector])
    start = np.cumsum(count) - count
    blocks = len(offsets) - 1
    of = np.searchsorted(offsets, np.arange(len(stream)), side="right") - 1
    place = start - start[offsets[:-1]][of] + of * block
    out = np.zeros(blocks * block + int(COUNTS[0]), np.uint64)
    for kind in range(2, 16):
        here = np.flatnonzero((selector == kind) & ~raw)
        if not len(here):
            continue
        n, width = int(COUNTS[kind]), np.uint64(WIDTHS[kind])
        mask = np.uint64((1 << int(width)) - 1)
        values = (stream[here][:, None] >> (np.arange(n, dtype=np.uint64) * width)) & mask
        to = place[here][:, None] + np.arange(n)
        if kind == 15:
            follows = np.flatnonzero(stream[here] == np.uint64(ESCAPE))
            values[follows, 0] = stream[here[follows] + 1]
            out[to] = values
        else:
            inside = to < (of[here][:, None] + 1) * block  # a block's last word may be filled up with zeros
            out[to[inside]] = values[inside]
    return out[:total]


class Writer:
    """Appends documents to one file; finish() gives it its name, so a task that died leaves none."""

    def __init__(self, uri: str, attempt: int, block: int = BLOCK):
        self.fs, self.path = filesystem(uri)
        self.temp, self.block = f"{self.path}.{attempt}", block
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(HEADER.pack(MAGIC, block))
        self.rest, self.held, self.ids, self.words = [], 0, 0, 0
        self.docs, self.nulls, self.lengths, self.sizes = [], [], [], []

    def add(self, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.array([x or 0 for x in doc_ids], np.int64))
        self.nulls.append(np.array([x is None for x in doc_ids], np.uint8))
        self.lengths.append(np.asarray(lengths, np.int64))
        self.rest.append(np.asarray(ids, np.uint64))
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= self.block * GROUP:
            held = np.concatenate(self.rest)
            whole = len(held) // self.block * self.block
            self._pack(held[:whole])
            self.rest, self.held = [held[whole:]], len(held) - whole

    def _pack(self, ids: np.ndarray) -> None:
        for i in range(0, len(ids), self.block * GROUP):
            stream, sizes = pack(ids[i : i + self.block * GROUP], self.block)
            self.out.write(stream.astype("<u8").tobytes())
            self.sizes.append(sizes)
            self.words += len(stream)

    def finish(self) -> None:
        self._pack(np.concatenate(self.rest) if self.rest else np.empty(0, np.uint64))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        sizes, docs = join(self.sizes, "<u8"), join(self.docs, "<i8")
        for x in (docs, join(self.nulls, "u1"), join(self.lengths, "<i8"), np.concatenate(([0], np.cumsum(sizes))).astype("<u8")):
            self.out.write(x.tobytes())
        self.out.write(TRAILER.pack(len(docs), len(sizes), self.ids, HEADER.size + 8 * self.words, MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.path)


def read_file(uri: str) -> Iterator[tuple[int | None, np.ndarray, bool]]:
    """(doc_id, some of its ids in order, whether they are the last) for each document of a file, in order."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        end = f.size()
        n_docs, n_blocks, n_ids, foot, magic = TRAILER.unpack(f.read_at(TRAILER.size, end - TRAILER.size))
        if magic != MAGIC or HEADER.unpack(f.read_at(HEADER.size, 0))[0] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        block = HEADER.unpack(f.read_at(HEADER.size, 0))[1]
        tail = f.read_at(end - TRAILER.size - foot, foot)
        docs = np.frombuffer(tail, "<i8", n_docs)
        nulls = np.frombuffer(tail, "u1", n_docs, 8 * n_docs)
        lengths = np.frombuffer(tail, "<i8", n_docs, 9 * n_docs)
        offsets = np.frombuffer(tail, "<u8", n_blocks + 1, 17 * n_docs).astype(np.int64)
        doc, left = 0, int(lengths[0]) if n_docs else 0
        for b in range(0, n_blocks, GROUP):
            part = offsets[b : b + GROUP + 1]
            stream = np.frombuffer(f.read_at(8 * int(part[-1] - part[0]), HEADER.size + 8 * int(part[0])), "<u8")
            ids = unpack(stream, part - part[0], min(n_ids - b * block, (len(part) - 1) * block), block)
            at = 0
            while at < len(ids):
                take = min(left, len(ids) - at)
                left -= take
                yield (None if nulls[doc] else int(docs[doc])), ids[at : at + take], not left
                at += take
                if not left:
                    doc += 1
                    left = int(lengths[doc]) if doc < n_docs else 0


#: How a vocabulary must cut texts for its words to be encoded each alone (fixed values of such a vocabulary).
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


class WordMemo:
    """Encodes texts with a lower-casing vocabulary that drops white space, each distinct word once.

    Where a vocabulary cuts texts as BY_WORDS says, it joins no characters across white space, nor a letter with the full
    stop or comma that ends a word, so a text's ids are those of these pieces in a row. Letters that don't end in a letter
    when they are composed and lowered (such as a capital I with a dot) are never cut from what follows. A-Z are lowered
    first, but in texts with combining marks, where composing comes before. Of two generations of the memo, the older is
    dropped when the newer has `most` pieces. With any other vocabulary whole texts go to the library.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.memo, self.older = Tokenizer.from_file(path), most, {}, {}
        ends = [i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if w.endswith("</w>")]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[ends] = True
        said = json.loads(self.tokenizer.to_str())
        first = ((said["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        cut = first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not any(c.isspace() for c in t["content"]) for t in said["added_tokens"])
        self.by_words = said["normalizer"] == BY_WORDS["normalizer"] and cut == ("Split", {"Regex": BY_WORDS["split"]}, "Removed", True) and plain
        self.stop = rf"([^\P{{L}}{self.unstable()}])([.,])( |$)" if self.by_words else ""

    def unstable(self) -> str:
        """The letters that don't stay or become letters alone, as a part of a character class."""
        letters = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha()]
        made = self.tokenizer.normalizer.normalize_str(" ".join(letters)).split(" ")
        return "".join(rf"\x{{{ord(c):X}}}" for c, m in zip(letters, made, strict=True) if not m.isalpha())

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if not self.by_words:
            found = [e.ids for e in self.encode(texts)]
            return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)
        whole = pa.array(texts, pa.large_string())
        marks = pc.match_substring_regex(whole, "[\u0300-\u036f]")
        lowered = pc.replace_substring(pc.if_else(marks, whole, pc.ascii_lower(whole)), "\n", " ")
        split = pc.split_pattern(pc.replace_substring_regex(lowered, self.stop, r"\1 \2\3"), " ")
        codes = split.flatten().dictionary_encode()
        pieces, index = codes.dictionary.to_pylist(), codes.indices.to_numpy()
        parts = self.look_up(pieces)
        table = np.frombuffer(b"".join(parts), np.uint32)
        size = np.array([len(p) // 4 for p in parts], np.int64)
        begin = np.cumsum(size) - size
        n = size[index]
        ends = np.cumsum(n)
        ids = table[np.repeat(begin[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate(([0], ends))[split.offsets.to_numpy()]
        return ids, np.diff(upto)

    def look_up(self, pieces: list[str]) -> list[bytes]:
        memo, older = self.memo, self.older
        missing = [p for p in pieces if p not in memo]
        fresh = [p for p in missing if p not in older]
        memo.update((p, older[p]) for p in missing if p in older)
        # Letters alone are one word of the vocabulary, whose last id says so: encode many in one call.
        alone = [p for p in fresh if p.isalpha()]
        lines = [alone[i : i + 256] for i in range(0, len(alone), 256)]
        for line, e in zip(lines, self.encode([" ".join(x) for x in lines]), strict=True):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(self.is_end[ids]) + 1
            if len(cuts) == len(line):
                raw, at = ids.tobytes(), 0
                for p, cut in zip(line, (4 * cuts).tolist(), strict=True):
                    memo[p], at = raw[at:cut], cut
        rest = [p for p in fresh if p not in memo]
        for p, e in zip(rest, self.encode(rest), strict=True):
            memo[p] = np.array(e.ids, np.uint32).tobytes()
        parts = [memo[p] for p in pieces]
        if len(memo) > self.most:
            self.memo, self.older = {}, memo
        return parts

    def encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)


@cache
def encoder(path: str) -> WordMemo:
    return WordMemo(path)


def batches(texts: list[str], chars: int = CHARS) -> Iterator[slice]:
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > chars:
            yield slice(start, i)
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(sizes), end_id), sizes + 1


SHARDS = "shard long, path string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encode documents (doc_id, text) into files in ascending doc_id order; a row for each file, in order of `shard`.

    Documents are dealt by ranges of doc_id, so each task writes one file and none holds more than a batch of text.
    Null texts are empty, null doc_ids come first, equal doc_ids follow each other in the order of their texts'
    hashes, and more columns are ignored.
    """

    def write(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out = TaskContext.get(), None
        shard = task.partitionId()
        path = f"{folder}/part-{shard:08d}.s8b"
        for part in parts:
            ids, texts = part.column("doc_id").to_pylist(), part.column("text")
            for s in batches(texts.to_pylist()):
                out = out or Writer(path, task.taskAttemptId())
                tokens, sizes = encoder(vocabulary)(texts[s.start : s.stop].to_pylist())
                tokens, sizes = with_end(tokens, sizes, end_id)
                out.add(ids[s], sizes, tokens)
        if out:
            out.finish()
            row = {"shard": [shard], "path": [path], "n_docs": [sum(map(len, out.docs))], "n_ids": [out.ids]}
            yield pa.RecordBatch.from_pydict(row)

    text = F.coalesce("text", F.lit(""))
    ordered = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie")).repartitionByRange("doc_id", "tie")
    return ordered.sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text").mapInArrow(write, SHARDS)


DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian uint32, from rows (path, base)."""

    def read(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, base in zip(part.column("path").to_pylist(), part.column("base").to_pylist(), strict=True):
                rows, crc, n, start = [], 0, 0, base
                for doc, ids, last in read_file(path):
                    crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                    n += len(ids)
                    if last:
                        rows.append((doc, start, n, crc))
                        start, crc, n = start + n, 0, 0
                    if len(rows) == 10_000:
                        yield as_batch(rows)
                        rows = []
                if rows:
                    yield as_batch(rows)

    return files.mapInArrow(read, DOCS)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in DOCS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def token_files(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Write documents as token files and read them back: doc_id, start, n_tokens, ids_crc32 from the files."""
    folder = folder or workspace(docs.sparkSession, "tokens")
    files = written(write_token_files(docs, vocabulary, f"{folder}/files"), folder, "manifest")
    # Where a file begins is the sum of those before it: one short row for each task that wrote one.
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = written(files.select("path", before.alias("base")), folder, "starts")
    return read_token_files(listed.repartition(max(1, files.count())))
