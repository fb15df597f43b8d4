import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sample():
    """Documents with every odd case: nulls in all columns, empty and blank texts, repeats, ties, a long text, near copies."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "delta", "épsilon", "ZETA", "eta.", "théta", "iota", "kappa", "lambda", "mu"]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, said(rng.randint(1, 120)) + "\nShared line " + str(k % 3), ["en", "fr", None][k % 3], ["s1", "s2", None, "s3"][k % 4]) for k in range(40)]
    base = said(90)
    rows += [(100 + k, base, "en", "s1") for k in range(4)]
    rows += [(110 + k, base.replace("alpha", "Alpha", k), "en", "s1") for k in range(3)]
    rows += [(120 + k, base + " " + w, "en", "s2") for k, w in enumerate(words)]
    rows += [(None, "a null id", "en", "s1"), (None, None, None, None), (200, None, "en", "s1"), (201, "", None, "s2"), (202, " \t\n\x0b\x0c\r ", "en", None)]
    rows += [(7, "another text under one id", "en", "s1"), (300, "repeated", "en", "s1"), (300, "repeated", "en", "s1")]
    rows += [(400, " ".join(said(20) for _ in range(400)), "de", "s9"), (401, "x" * 5000, "de", "s9"), (402, "é\u0301 \u3000 ＡＢ 漢字 İ ǅ 𝒳\n\n\nz\r\n", "de", "s9"), (-5, "minus five", "en", "s1")]
    return [(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows]


@pytest.fixture(scope="session")
def rows():
    return sample()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with more columns, named as the operators' own."""
    from pyspark.sql import functions as F

    names = ["row", "size", "part", "idx", "block", "h", "fp", "th", "root", "runs", "pos", "kept", "m", "bin", "n", "level", "host", "path", "rule", "verdict", "ids", "shard", "taken", "known", "a", "e", "k"]
    names += [f"__{n}" for n in ("d", "t", "s", "k", "n", "m", "doc", "runs", "kept", "take", "takes", "text", "lang", "source", "n_lines", "n_dropped", "key", "pos", "line", "at", "row")]
    return docs.select("*", *(F.lit("more").alias(n) for n in names))
