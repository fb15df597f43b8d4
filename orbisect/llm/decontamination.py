"""Operator 12: benchmark decontamination with one Aho-Corasick automaton over the windows of all test items.

Texts are folded byte by byte (A-Z in lower case, all that is in no word a space) and their words joined by single spaces;
a window is its words between spaces, so the automaton meets whole words alone. A text is scanned once, and what is found
is mapped back to offsets in the original text. Documents aren't shuffled. Windows are dealt in blocks of bounded size;
where the benchmark needs several, each block is a pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, workspace, written

#: Words are runs of anything but these; A-Z count as a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for bytes: digits, a-z and bytes of characters beyond ASCII stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of windows in a block: its automaton has as many nodes at most, of 40 bytes each.
BLOCK_BYTES = 2 << 20

FOUND = "struct<n_words: long, n_hit: long, item_ids: array<long>, spans: array<struct<first_word: long, n_words: long, start: long, end: long>>>"


def windows(benchmark: DataFrame, size: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """window, n_words, item_id: the distinct windows of each item, size words long or all words of a shorter item."""
    ws = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), ws.alias("ws")).where("size(ws) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (size - 1), F.lit(1)))
    cut = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("ws", i, size))).alias("w"))
    return cut.select(F.array_join("w", " ").alias("window"), F.size("w").alias("n_words"), "item_id").distinct()


def automaton(rows: list[tuple[str, int, int | None]]) -> ahocorasick.Automaton:
    """The automaton over windows (text, words, item). Its keys are UTF-8 bytes, each a character."""
    keys: dict[str, tuple[int, set[int]]] = {}
    for window, n, item in rows:
        known = keys.setdefault(window, (n, set()))
        if item is not None:
            known[1].add(item)
    found = ahocorasick.Automaton()
    for window, value in keys.items():
        found.add_word(f" {window} ".encode().decode("latin-1"), value)
    found.make_automaton()
    return found


def searched(raw: bytes, automaton: ahocorasick.Automaton, before: dict | None) -> dict:
    """What is found in one text, with what earlier passes found in it."""
    ws = raw.translate(FOLD).split()
    # raw's runs of word bytes are these words, in order.
    line = (b" " + b" ".join(ws) + b" ").decode("latin-1")
    ends, lengths, items = [], [], set(before["item_ids"] if before else ())
    for end, (n, own) in automaton.iter(line) if ws else ():
        ends.append(end)
        lengths.append(n)
        items |= own
    if not ends:
        return before or {"n_words": len(ws), "n_hit": 0, "item_ids": [], "spans": []}
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    stop = np.searchsorted(spaces, ends)  # words before the space that ends a window
    start = stop - lengths
    if before:
        at = np.array([(s["first_word"], s["first_word"] + s["n_words"]) for s in before["spans"]], dtype=np.int64).reshape(-1, 2)
        start, stop = np.concatenate([start, at[:, 0]]), np.concatenate([stop, at[:, 1]])
    change = np.bincount(start, minlength=len(ws) + 1) - np.bincount(stop, minlength=len(ws) + 1)
    hit = np.concatenate([[0], (np.cumsum(change)[:-1] > 0).view(np.int8), [0]])
    first, last = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
    spans = original(raw, first, last)
    return {"n_words": len(ws), "n_hit": int((last - first).sum()), "item_ids": sorted(items), "spans": spans}


def original(raw: bytes, first: np.ndarray, last: np.ndarray) -> list[dict]:
    """Runs of words from first up to last, with their offsets in the text, in code points."""
    letters = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
    edges = np.diff(np.concatenate([[0], letters.view(np.int8), [0]]))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [
        {"first_word": int(a), "n_words": int(b - a), "start": int(points[begins[a]]), "end": int(points[ends[b - 1]])}
        for a, b in zip(first, last, strict=True)
    ]


def scanned(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", into: str = "found", columns: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a column of what each text has of the benchmark: its words, those within an occurrence of a window, the items
    that have occurring windows (ascending), and the hit runs as words and as code points of the text, end exclusive.

    Null and empty texts have no words, items without words no windows; an item without id marks words but is no item of
    the list. Repeated rows are rows each, repeated items one. A column that is called as into is replaced; others stay,
    or those that columns names.
    """
    columns = [c for c in columns or docs.columns if c != into]
    folder = workspace(docs.sparkSession, "windows")
    known = written(windows(benchmark, size), folder, "windows")
    total = known.agg(F.sum(F.octet_length("window") + 2)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = docs
    for block in range(blocks):
        own = known.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks)) == block)
        # About block_bytes, whatever the benchmark's size.
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in own.select("window", "n_words", "item_id").collect()])
        rows = one_pass(rows, shared, text, into, [*dict.fromkeys([*columns, *([text] if block + 1 < blocks else [])])], block > 0)
        if block + 1 < blocks:
            rows = written(rows, folder, f"pass-{block}")
    return rows


def one_pass(rows: DataFrame, shared, text: str, into: str, columns: list[str], again: bool) -> DataFrame:
    """rows searched for one block of windows; again: the column of finds holds those of earlier blocks."""
    schema = T.StructType([*(rows.schema[c] for c in columns), T.StructField(into, T._parse_datatype_string(FOUND))])
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([(n, pa.int64()) for n in ("first_word", "n_words", "start", "end")])))])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton(shared.value) if shared.value else None
        for batch in batches:
            texts = batch.column(text).cast(pa.binary())
            before = batch.column(into) if again else None
            found = []
            for k in range(batch.num_rows):
                raw, old = texts[k].as_py() or b"", before[k].as_py() if again else None
                found.append(searched(raw, known, old) if known else old or {"n_words": len(raw.translate(FOLD).split()), "n_hit": 0, "item_ids": [], "spans": []})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, kind)], [*columns, into])

    return rows.select(*dict.fromkeys([*columns, text, *([into] if again else [])])).mapInArrow(scan, schema)
