import random
import re

import pytest
from pyspark.sql import functions as F

from orbisect.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(text, items, size):
    """Every window of every item against every place of the text."""
    ws = words(text)
    hit, met = set(), set()
    for item, said in items:
        iw = words(said)
        for k in range(max(1, len(iw) - size + 1) if iw else 0):
            w = iw[k : k + size]
            for at in range(len(ws) - len(w) + 1):
                if ws[at : at + len(w)] == w:
                    hit |= set(range(at, at + len(w)))
                    met |= {item} - {None}
    return len(ws), sorted(hit), sorted(met)


def held(df, docs, items, size):
    got = sorted(((r.doc_id, r.text, r.found) for r in df.collect()), key=str)
    assert len(got) == len(docs)
    for _, text, found in got:
        n, hit, met = plain(text, items, size)
        assert (found.n_words, found.n_hit, list(found.item_ids)) == (n, len(hit), met)
        assert [k for s in found.spans for k in range(s.first_word, s.first_word + s.n_words)] == hit
        for s in found.spans:
            assert words(text[s.start : s.end]) == words(text)[s.first_word : s.first_word + s.n_words]
            assert WORD.fullmatch(text[s.start].translate(LOWER)) and WORD.fullmatch(text[s.end - 1].translate(LOWER))


def sample():
    r = random.Random(2)
    vocab = ["a", "b", "C", "é", "漢字", "7x", "ÉÀ", "d'e", "zz"]
    said = lambda n: "".join(r.choice(vocab) + r.choice([" ", "  ", ", ", "\n", "-", ". ", "\t_"]) for _ in range(n))
    items = [(k, said(r.randint(1, 9))) for k in range(12)] + [(90, None), (91, ""), (92, "..."), (None, "zz zz zz"), (93, "b"), (93, "a a")]
    docs = [(k, said(r.randint(0, 60))) for k in range(40)] + [(50, None), (51, ""), (52, " .-"), (None, "b b"), (50, "zz ZZ, zz"), (50, "zz ZZ, zz"), (53, said(20_000))]
    return docs, items


@pytest.mark.parametrize(("size", "block"), [(3, 1 << 20), (2, 60)])
def test_as_brute_force(spark, size, block):
    """In one pass, and in many passes over small blocks of windows."""
    docs, items = sample()
    if block < 100:
        docs = docs[:-1]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    held(D.scanned(df, bench, size, block_bytes=block), docs, items, size)


def test_words_not_parts_of_words(spark):
    df = spark.createDataFrame([(1, "xone two threex"), (2, "one two three"), (3, "One--TWO (three)"), (4, "one two"), (5, "éone two three")], "doc_id long, text string")
    found = D.scanned(df, spark.createDataFrame([(1, "one two three")], "item_id long, text string"))
    assert {r.doc_id: r.found.n_hit for r in found.collect()} == {1: 0, 2: 3, 3: 3, 4: 0, 5: 0}
    spans = {r.doc_id: [tuple(s) for s in r.found.spans] for r in found.collect()}
    assert spans[3] == [(0, 3, 0, 15)] and spans[2] == [(0, 3, 0, 13)]


def test_odd_tables(spark):
    docs, items = sample()
    bench = spark.createDataFrame(items, "item_id long, text string")
    none = bench.limit(0)
    df = spark.createDataFrame(docs[:10], "doc_id long, text string")
    assert {r.found.n_hit for r in D.scanned(df, none).collect()} == {0}
    assert [r.found.n_words for r in D.scanned(df, none).orderBy("doc_id").collect()] == [len(words(t)) for _, t in docs[:10]]
    assert D.scanned(df.limit(0), bench).collect() == []
    clash = df.select("*", *(F.lit("m").alias(c) for c in ("found", "window", "item_id", "n_words", "ws", "w")))
    got = D.scanned(clash, bench, 3)
    assert got.columns == ["doc_id", "text", "window", "item_id", "n_words", "ws", "w", "found"]
    held(got, docs[:10], items, 3)
    assert D.scanned(clash, bench, 3, columns=["doc_id"]).columns == ["doc_id", "found"]
