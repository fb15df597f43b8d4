import re
from collections import Counter

from orbisect.llm import quality as Q


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for k in range(len(w) - 2):
        if seen[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def digest(df):
    return sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in df.collect())


def test_counts(spark, docs, rows):
    assert digest(Q.rated(docs)) == sorted(str((i, *counts(t))) for i, t, *_ in rows)
    odd = ["a b c a b c", "a a a a", "x y z\nx y z\n\nx y z", "#*$%&|<> # a", "a b c d a b c e b c d"]
    df = spark.createDataFrame([(k, t, None, None) for k, t in enumerate(odd)], "doc_id long, text string, lang string, source string")
    assert digest(Q.rated(df)) == sorted(str((k, *counts(t))) for k, t in enumerate(odd))


def corpus(spark):
    import random

    rng = random.Random(0)
    syllables = ["ba", "ko", "ri", "tu", "ne", "sa", "mi", "lo", "ve", "du"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    clean = [(k, " ".join(word() for _ in range(rng.randint(60, 300))), rng.choice(["en", "fr"]), rng.choice(["s1", "s1", "s2"])) for k in range(400)]
    junk = [(1000 + k, " ".join(word() + "###" for _ in range(100)), "en", "s1") for k in range(20)]
    junk += [(1100 + k, "\n".join([" ".join(word() for _ in range(2))] * 60), "fr", "s2") for k in range(5)]
    return clean, junk, spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")


def test_clean_documents_stay_and_junk_goes(spark):
    clean, junk, docs = corpus(spark)
    kept = {r.doc_id for r in Q.rated(docs).where("kept").collect()}
    assert kept == {r[0] for r in clean}
    assert {r.doc_id for r in Q.filtered(docs).collect()} == kept


def test_sketches_merge(spark):
    _, _, docs = corpus(spark)
    rows = Q.measured(docs)
    whole = Q.sketches(rows)
    halves = Q.sketches(rows.where("doc_id % 2 = 0")).union(Q.sketches(rows.where("doc_id % 2 = 1")))
    merged = halves.groupBy("lang", "source", "fence", "bin").sum("n")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))


def test_quantiles_are_within_the_bins(spark):
    _, _, docs = corpus(spark)
    rows = Q.measured(docs)
    low = Q.fences_of(Q.sketches(rows)).where("lang = 'en' AND source = 's1'").first()
    ok = [r.m.word_chars / r.m.n_words for r in rows.where("lang = 'en' AND source = 's1'").collect() if r.m.n_words >= 50]
    ok.sort()
    q1, q3 = ok[len(ok) // 4], ok[3 * len(ok) // 4]
    reach = 8.0 * max(q3 - q1, 0.3)
    assert abs(low.high_word_length - (q3 + reach)) < 0.06 * q3 * 9


def test_odd_tables(docs, empty, clashing):
    assert Q.rated(empty).collect() == [] and Q.filtered(empty).collect() == []
    assert digest(Q.rated(clashing)) == digest(Q.rated(docs))
    assert Q.filtered(clashing).columns == clashing.columns
