import hashlib
import math
from collections import Counter

import regex
import xxhash

from orbisect.llm import imatch as I


def plain(spark, n=60):
    """Documents with ids of their own."""
    import random

    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 300))) for _ in range(n)]
    return [(k, t) for k, t in enumerate(texts)] + [(n, texts[3]), (n + 1, ""), (n + 2, None), (n + 3, "é" * 7)]


def test_contract(spark):
    rows = plain(spark)
    got = {r.doc_id: r for r in I.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
    assert got[3].fingerprint == got[60].fingerprint and got[61].fingerprint == got[62].fingerprint
    assert got[61].near_next == 1.0 and got[61].near_edited == 1.0
    long = [i for i, t in rows if t and len(t.split()) > 100]
    assert sum(got[i].near_edited for i in long) > 3 * sum(got[i].near_next for i in long)


def spark_hash(x, seed=42):
    """Spark's xxhash64 of a string, a long or an array of longs, as a signed long."""
    for part in x if isinstance(x, list) else [x]:
        raw = part.encode() if isinstance(part, str) else part.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute(rows):
    """doc_id: (fingerprint, edited, near_edited, near_next), by hand."""
    texts = [t or "" for _, t in rows]
    terms = lambda t: {spark_hash(x) for x in regex.findall(r"[\p{L}\p{N}]+", "".join(c.lower() if c.isascii() else c for c in t))}
    n, df = len(rows), Counter(h for t in texts for h in terms(t))
    band = {h for h, c in df.items() if n ** (1 - I.HIGH) - 1e-9 <= c <= n ** (1 - I.LOW) + 1e-9}

    def signed(t):
        own = terms(t)
        by = max(0, math.floor(math.log2(max(1, len(own)) / (I.FEW * I.SUBSETS))))
        signs = []
        for thin in (by, by + 1):
            kept = sorted(h for h in own & band if h % (1 << thin) == 0)
            for k in range(I.SUBSETS):
                part = [h for h in kept if ((h % (1 << 64)) >> 32) % I.SUBSETS == k]
                signs.append(spark_hash(part) if part else None)
        hexed = lambda h: f"{h % (1 << 64):X}".lower()
        whole = f"text:{hexed(spark_hash(t))}"
        return by, signs, f"{by}:" + ":".join("-" if s is None else hexed(s) for s in signs) if any(s is not None for s in signs) else whole

    def near(a, b):
        if a[2] == b[2]:
            return 1.0
        top = max(a[0], b[0])
        if abs(a[0] - b[0]) > 1:
            return 0.0
        x, y = (s if a[0] == b[0] else s[(top - by) * I.SUBSETS :][: I.SUBSETS] for by, s, _ in (a, b))
        some = [(p, q) for p, q in zip(x, y) if p is not None or q is not None]
        return sum(p == q for p, q in some) / len(some) if some else 0.0

    out = {}
    for k, (i, _) in enumerate(rows):
        t, after = texts[k], texts[(k + 1) % len(rows)]
        a, e, nxt = signed(t), signed(t[: len(t) - len(t) // 4] + after[: len(t) // 4]), signed(after)
        out[i] = (a[2], e[2], near(a, e), near(a, nxt))
    return out


def test_against_brute_force(spark):
    rows = plain(spark, 150) + [(900, "ÀÉ straße 漢字 x1 x1\u0301, W3 w3"), (901, "Àé straße 漢字 x1"), (902, " ".join(f"w{k}" for k in range(390)))]
    got = I.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute(sorted(rows))
    for r in got:
        assert (r.fingerprint, r.edited_fingerprint) == want[r.doc_id][:2], r.doc_id
        assert abs(r.near_edited - want[r.doc_id][2]) < 1e-9 and abs(r.near_next - want[r.doc_id][3]) < 1e-9, r.doc_id
    assert len(got) == len(want) and len({v[2] for v in want.values()}) > 5


def test_stretches_dont_change_the_result(spark, monkeypatch):
    rows = plain(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, I.fingerprinted(docs).collect()))
    monkeypatch.setattr(I, "STRETCH", 4)
    assert sorted(map(str, I.fingerprinted(docs).collect())) == want


def test_odd_tables(docs, rows, empty, clashing):
    got = sorted(map(str, I.fingerprinted(docs).collect()))
    assert len(got) == len(rows) and I.fingerprinted(empty).collect() == []
    assert sorted(map(str, I.fingerprinted(clashing).collect())) == got
