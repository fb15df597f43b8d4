import re
from collections import defaultdict

import pytest

from orbisect.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, weights, cap, share=1.0):
    """Targets by capping again and again."""
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        level = left / sum(weights[s] for s in free) if free else 0
        over = [s for s in free if level * weights[s] > cap * sizes[s]]
        if not over:
            return {s: cap * sizes[s] if s in capped else level * weights[s] for s in sizes}
        capped |= set(over)


def checked(docs, rows, mix):
    got = M.taken_words(docs, mix).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    of = {}
    for i, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
        of[i] = s
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights = {s: mix.weights[k % len(mix.weights)] for k, s in enumerate(names)}
    want = water(sizes, weights, mix.cap, mix.share)
    by_size = defaultdict(list)
    for r in got:
        assert r.taken <= mix.cap * r.size
        by_size[r.source_size, round(r.target, 6)].append(r)
    for (size, goal), own in by_size.items():
        same = [s for s in names if sizes[s] == size and want[s] == pytest.approx(goal)]
        assert same and sum(r.taken for r in own) == len(same) * round(goal)
    assert len(got) == len(rows) and sorted(map(str, M.taken_words(docs, mix).collect())) == sorted(map(str, got))
    return got


@pytest.mark.parametrize("block", [4, 64, 2048])
def test_words_come_out_at_the_targets(docs, rows, block):
    checked(docs, rows, M.Mix(block_words=block, shard_slots=16))


def test_caps_reshare_the_excess(docs, rows):
    checked(docs, rows, M.Mix(weights=(1, 1, 500), cap=2, block_words=8))


def test_texts_hold_what_is_taken(docs, rows):
    mix = M.Mix(block_words=16, shard_slots=8)
    taken = sum(r.taken for r in M.taken_words(docs, mix).collect())
    texts = M.mixed_texts(docs, mix).collect()
    assert sum(len(WORD.findall(r.text)) for r in texts) == taken
    whole = defaultdict(set)
    for i, t, *_ in rows:
        whole[i].add(t)
    assert all(r.n_chars == len(r.text) for r in texts)
    joined = lambda t: " ".join(WORD.findall(t or ""))
    starts = {i: [joined(t) for t in ts] for i, ts in whole.items()}
    exact = sum(any(joined(r.text) in t for t in starts[r.doc_id]) for r in texts)
    assert exact >= 0.8 * len(texts)  # the others join spans that lie apart


def test_permutations(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        key = [F.lit(3), F.lit(1)]
        df = spark.range(n).withColumn("p", M.permuted(F.col("id"), F.lit(n), key, 42)).withColumn("q", M.permuted(F.col("p"), F.lit(n), key, 42, inverse=True))
        rows = df.collect()
        assert sorted(r.p for r in rows) == list(range(n)) and all(r.q == r.id for r in rows)


def test_odd_tables(empty, clashing, docs):
    assert M.taken_words(empty).collect() == [] and M.mixed_texts(empty).collect() == []
    assert sorted(map(str, M.taken_words(clashing).collect())) == sorted(map(str, M.taken_words(docs).collect()))
    assert M.mixed_texts(clashing).columns == clashing.columns


def test_one_text_under_two_sources(spark):
    """Rows that share a doc_id and a text, but not a source, are told apart: each source comes out at its target."""
    said = " ".join(f"w{k}" for k in range(100))
    rows = [(1, said, "en", "A", 0), (1, said, "de", "B", 0), (2, said.upper(), "en", "B", 0)]
    mix = M.Mix(weights=(1, 9), block_words=10, shard_slots=8)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want, got = defaultdict(int), defaultdict(int)
    for r in M.taken_words(df, mix).collect():
        want[r.source_size] += r.taken
    texts = M.mixed_texts(df, mix).collect()
    for r in texts:
        got[{"A": 100, "B": 200}[r.source]] += len(WORD.findall(r.text))
    assert got == want and {(r.source, r.lang) for r in texts if r.doc_id == 1} <= {("A", "en"), ("B", "de")}
    again = M.mixed_texts(df.repartition(2), mix).collect()
    assert sorted(map(str, again)) == sorted(map(str, texts))
