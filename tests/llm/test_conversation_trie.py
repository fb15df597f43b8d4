import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orbisect.llm import conversation_trie as T

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def told(turns, family=5, heads=9):
    """conv_id and its turns after the heads are replaced; ties in order of the digest, as the operator says."""
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((t is not None, t or 0), digest, role, text))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % heads for c in own}
    return {c: own.get(c - c % family, [])[: h[c]] + v[h[c] :] for c, v in own.items()}


def plain(convs):
    nodes = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        todo, out = [p], []
        while todo:
            out.append(q := todo.pop())
            todo += kids[q]
        return out

    rows = []
    for p, members in nodes.items():
        under = below(p)
        ends = sorted(c for c in members if len(convs[c]) == len(p))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        rows.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), sum(not kids[q] for q in under), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(map(str, rows))


def got(df):
    return sorted(str(tuple(r)) for r in df.select(COLUMNS).collect())


def talks(n, seed, most=7, words=3):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), r.choice(["", "hello", "é" * 3, "x" * 50][:words])) for c in range(n) for t in range(r.randint(1, most))]


@pytest.mark.parametrize(("n", "seed", "fan"), [(60, 1, 2), (400, 2, 3), (30, 4, 32)])
def test_as_brute_force(spark, n, seed, fan):
    """Few different turns, so that nodes lie across many tasks; in several rounds of stitches and in one."""
    turns = talks(n, seed, words=2)
    df = spark.createDataFrame(turns, TURNS).repartition(3)
    assert got(T.trie(T.rebuilt(df), fan=fan)) == plain(told(turns))


def test_one_conversation_repeated(spark):
    """Equal arrays are dealt to many tasks and hashed in blocks."""
    turns = [(c, t, "user", f"said {t}") for c in range(0, 3000, 5) for t in range(3)] + [(7, 0, "user", "said 0"), (11, 0, "user", "else")]
    assert got(T.prefix_trie(spark.createDataFrame(turns, TURNS))) == plain(told(turns))


def test_odd_tables(spark):
    turns = talks(20, 9) + [(None, 0, "user", "lost"), (3, None, None, None), (3, None, "b", "a"), (3, 2, "tie", "1"), (3, 2, "tie", "2"), (3, 2, "tie", "2"), (-4, 0, "user", "minus"), (-5, 0, "a", "base"), (-5, 1, "a", "more"), (1 << 40, 0, "", "y" * 200_000)]
    turns += [(c, 0, "user", "short") for c in (101, 102, 103, 104)]  # their family's first conversation is missing
    df = spark.createDataFrame(turns, TURNS)
    want = plain(told(turns))
    assert got(T.prefix_trie(df)) == want
    more = df.select("*", *(F.lit("m").alias(c) for c in ("base", "digest", "size", "own", "lead", "node", "kind", "part", "ids", "turns")))
    assert got(T.prefix_trie(more)) == want
    assert T.prefix_trie(df.limit(0)).collect() == []
    assert T.prefix_trie(df.where("conv_id IS NULL")).collect() == []


def arrays(convs):
    return sorted(([bytes([x]) * 16 for x in v], c) for c, v in convs.items())


def test_runs_stitch_in_any_order():
    """Runs of single arrays, met in a random tree, close the same nodes as in one sweep."""
    r = random.Random(5)
    for trial in range(40):
        rows = arrays({c: [r.randint(1, 2) for _ in range(r.randint(0, 6))] for c in range(25)})
        made = []
        for k, (digests, conv) in enumerate(rows):
            path = [T.Node(T.ROOT, 0)]
            for x in digests:
                path.append(T.Node(path[-1].key + x, 1))
            path[-1].add(1, conv)
            made.append(T.Run(digests, digests, path, list(path)))
        found = []
        close = lambda n, p, d: found.append((n.key, d, n.n, n.least, n.children, n.leaves, n.saved))
        while len(made) > 1:
            k = r.randrange(len(made) - 1)
            made[k].meet(T.Run.load(made.pop(k + 1).dump()) if trial % 2 else made.pop(k + 1), close)
        made[0].finish(close)
        members = defaultdict(list)
        for digests, conv in rows:
            for d in range(len(digests) + 1):
                members[tuple(digests[:d])].append(conv)
        assert sorted((len(p), len(m), min(m)) for p, m in members.items()) == sorted(x[1:4] for x in found)
        assert max(found, key=lambda x: -x[1])[2] == 25
