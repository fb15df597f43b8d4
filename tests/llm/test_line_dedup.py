import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from orbisect.llm import line_dedup as L

BLANK = " \t\n\x0b\x0c\r"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def expected(rows, least):
    found = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            found[lower(line.strip(BLANK))].add((i, t))
    gone = {k for k, d in found.items() if k and len(d) >= least}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if lower(x.strip(BLANK)) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(str, out))


def digest(df):
    rows = df.select("doc_id", "__n_lines", "__n_dropped", F.sha2("text", 256)).collect()
    return sorted(str(tuple(r)) for r in rows)


def test_frequent_lines_go_everywhere(docs, rows):
    for least in (2, 10):
        assert digest(L.deduplicated(docs, least)) == expected(rows, least)


def test_cases_of_letters(spark):
    texts = ["ÉTÉ x\nABC  ", "été x\nabc", "Été x\n\tAbC", "İSTANBUL", "i̇stanbul", "ΑΣ", "ας", "ǅ", "ǆ", "K", "k", "Å", "å"]
    rows = [(k, t, None, None, 0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    assert digest(L.deduplicated(docs, 2)) == expected(rows, 2)


def test_odd_tables(empty, clashing, docs):
    assert L.deduplicated(empty).collect() == []
    assert digest(L.deduplicated(clashing, 2)) == digest(L.deduplicated(docs, 2))
    assert L.deduplicated(clashing, 2).drop("__n_lines", "__n_dropped").columns == [c for c in clashing.columns if c not in ("__n_lines", "__n_dropped")]
