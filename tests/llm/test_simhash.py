import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from orbisect.llm import simhash as S


def reference(text, size=3):
    """Bit by bit."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    v = sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles)) if shingles else 0
    return v - (1 << 64) if v >> 63 else v


def groups(items, most, roots=False):
    """Union of all pairs within `most` bits: (id, fp) to the least id that links lead to."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(items)):
        for b in range(a):
            if ((items[a][1] ^ items[b][1]) & (2**64 - 1)).bit_count() <= most:
                root[find(a)] = find(b)
    if roots:
        return {find(k) for k in range(len(items))}
    least = {}
    for k, (i, _) in enumerate(items):
        r = find(k)
        least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
    return [least[find(k)] for k in range(len(items))]


@pytest.mark.parametrize("size", [3, 5])
def test_groups_are_all_links(docs, rows, size):
    items = [(i, reference(t, size)) for i, t, *_ in rows]
    want = sorted(str((i, fp, c)) for (i, fp), c in zip(items, groups(items, 3)))
    got = S.grouped(docs, size).collect()
    assert sorted(str((r.doc_id, r.fp, r.component_id)) for r in got) == want
    assert len(set(want)) < len(want)


@pytest.mark.parametrize("crowded", [0, 2, 10_000])
def test_every_close_pair_is_met(spark, tmp_path, crowded):
    rng = random.Random(9)
    values = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(6):
            v = base
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v - (1 << 64) if v >> 63 else v)
    fps = spark.createDataFrame([(v,) for v in sorted(values)], "fp long")
    got = {(r.a, r.b) for r in S.looked_up(fps, f"file://{tmp_path}/c", 3, crowded).distinct().collect()}
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and want


def test_one_of_each_group_stays(docs, rows, clashing):
    kept = S.one_of_each(docs, S.grouped(docs, 3)).collect()
    items = [(i, reference(t)) for i, t, *_ in rows]
    assert len(kept) == len(groups(items, 3, roots=True))
    again = S.one_of_each(clashing, S.grouped(clashing, 3))
    assert again.columns == clashing.columns and again.count() == len(kept)


def test_empty(empty):
    assert S.grouped(empty).collect() == [] and S.one_of_each(empty, S.grouped(empty)).collect() == []
    assert S.grouped_by_similarity(empty).collect() == []


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def test_estimates_follow_the_similarity(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = []
    for k, cut in enumerate((0, 5, 20, 60, 200)):
        other = base[: 400 - cut] + [f"v{rng.randrange(5000)}" for _ in range(cut)]
        (a, n), (b, m) = S.long_fingerprint(" ".join(base)), S.long_fingerprint(" ".join(other))
        x, y = shingles(" ".join(base)), shingles(" ".join(other))
        rows.append((a, n, b, m, len(x & y) / len(x | y)))
    df = spark.createDataFrame(rows, "a array<long>, n long, b array<long>, m long, j double")
    for r in df.select("j", S.estimated(F.col("a"), F.col("n"), F.col("b"), F.col("m")).alias("e")).collect():
        assert abs(r.j - r.e) < (0.08 if r.j > 0.6 else 0.2)


@pytest.mark.parametrize("crowded", [3, 64])
def test_near_copies_are_grouped(spark, crowded, monkeypatch):
    """Groups of near copies (a word or two changed in 150) come together; unlike texts, and texts half alike, stay apart."""
    rng = random.Random(7)
    said = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    rows, group = [], {}
    for g in range(25):
        base = said(150)
        for _ in range(6 if g else 40):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(150)] = f"x{rng.randrange(9000)}"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(w)))
        half = base[:75] + said(75)
        group[len(rows)] = ("half", g)
        rows.append((len(rows), " ".join(half)))
    similar = S.similar
    monkeypatch.setattr(S, "similar", lambda fps, folder, least: similar(fps, folder, least, crowded))
    got = {r.doc_id: r.component_id for r in S.grouped_by_similarity(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for i in sorted(group):
        first.setdefault(group[i], i)
    assert got == {i: first[g] for i, g in group.items()}


def test_odd_texts_are_grouped_with_their_equals(docs, rows):
    got = S.grouped_by_similarity(docs).collect()
    assert len(got) == len(rows)
    blank = {r.component_id for r in got if r.doc_id in (200, 201, 202)}
    assert blank == {200}


def linked(texts, least=0.8, size=5):
    """The least number of each text's component under all pairs of `least` or more, by brute force."""
    sets, root = [shingles(t, size) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if len(x & y) >= least * len(x | y) - 1e-9 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in range(len(texts))}


def components(spark, texts, **more):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in S.grouped_by_similarity(rows, **more).collect()}


def test_pairs_at_the_threshold_are_met_however_many_texts_there_are(spark):
    """400 pairs of a similarity of 0.8 to 0.83 among 263,000 other texts."""
    rng = random.Random(11)
    texts = []
    for k in range(400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        texts += [" ".join(base), " ".join(base[:-19] + [f"y{k}-{j}" for j in range(19)] if k % 2 else base[21:] + [f"z{k}-{j}" for j in range(1)])]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    others = spark.range(1000, 264_000).selectExpr("id AS doc_id", "concat('a', id) AS text")
    got = {r.doc_id: r.component_id for r in S.grouped_by_similarity(own.unionByName(others)).where("doc_id < 1000").collect()}
    assert got == {k: k - k % 2 for k in range(800)}
    assert all(0.8 <= len(x & y) / len(x | y) < 0.9 for x, y in ((shingles(texts[k]), shingles(texts[k + 1])) for k in range(0, 800, 2)))


@pytest.mark.parametrize("own", [40, 75])
def test_pairs_inside_a_crowd_are_met(spark, own):
    """Texts of one long template; their pairs of 0.85 to 0.9 are linked, others (0.6 to 0.76) are not."""
    rng = random.Random(12)
    template, texts = [f"t{j}" for j in range(300 - own)], []
    for k in range(300):
        base = template + [f"w{rng.randrange(10**6)}" for _ in range(own)]
        texts += [" ".join(base), " ".join(base[: 300 - rng.randint(16, 24)] + [f"x{rng.randrange(10**6)}" for _ in range(20)])]
    want = linked(texts)
    assert components(spark, texts) == want and len(set(want.values())) == 300


@pytest.mark.parametrize("crowded", [1, 16])
def test_links_between_others_than_the_first_are_found(spark, crowded, monkeypatch):
    """Chains of texts: each is like the next ones, none like the far ones, and all share crowded shingles."""
    rng = random.Random(13)
    texts = []
    for c in range(3):
        words = [f"c{c}-{rng.randrange(10**6)}" for _ in range(1200)]
        texts += [" ".join(words[k : k + 200]) for k in range(0, 1000, 6)]
    rng.shuffle(texts)
    similar = S.similar
    monkeypatch.setattr(S, "similar", lambda fps, folder, least: similar(fps, folder, least, crowded))
    want = linked(texts)
    assert components(spark, texts) == want and len(set(want.values())) == 3


@pytest.mark.parametrize(("phrase", "times"), [(["-"], 64), ([f"p{j}" for j in range(5)], 30), ([f"p{j}" for j in range(5)], 25)])
def test_a_repeated_phrase_links_no_unlike_texts(spark, phrase, times):
    rng = random.Random(14)
    texts = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(454)] + phrase * times) for _ in range(6)]
    assert components(spark, texts) == {k: k for k in range(6)}


def test_estimates_count_a_shingle_once(spark):
    rng = random.Random(15)
    (a, n), (b, m) = (S.long_fingerprint(" ".join([f"w{rng.randrange(10**6)}" for _ in range(454)] + ["-"] * 64)) for _ in range(2))
    df = spark.createDataFrame([(a, n, b, m)], "a array<long>, n long, b array<long>, m long")
    assert df.select(S.estimated(F.col("a"), F.col("n"), F.col("b"), F.col("m")).alias("e")).first().e < 0.1
