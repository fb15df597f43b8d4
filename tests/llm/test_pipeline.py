import re

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer  # noqa: F401  the vocabulary's library is there

from orbisect.llm import pieces, queries

from ..compare import duckdb_rows, spark_rows
from .test_simhash import shingles


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_give_what_their_sql_gives(spark, sf, name):
    assert spark_rows(queries.queries()[name](spark, sf)) == duckdb_rows(queries.oracle_sql()[name], sf)


def test_every_query_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))


def brute(rows):
    """The texts after line dedup, by hand."""
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    found: dict[str, set] = {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            found.setdefault(lower(line.strip(" \t\n\x0b\x0c\r")), set()).add(r["doc_id"])
    out = []
    for r in rows:
        kept = [x for x in (r["text"] or "").split("\n") if not (k := lower(x.strip(" \t\n\x0b\x0c\r"))) or len(found[k]) < 10]
        out.append(r | {"text": "\n".join(kept)})
    return {r["doc_id"]: r["text"] for r in out}


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        seen.append([r.asDict() for r in docs.collect()])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    first = {r["doc_id"] for r in seen[0]}
    rated = queries.op9_quality(spark, sf).collect()
    assert first == {r.doc_id for r in rated if r.kept}
    assert all(r.base_failed or r.kept for r in rated if labels.get(r.doc_id) == 1)
    lines = brute(seen[0])
    assert {r["doc_id"]: r["text"] for r in seen[1]} == lines
    kept = {r["doc_id"]: r["text"] for r in seen[2]}
    assert all(lines[i] == t for i, t in kept.items())
    # Who went has a near copy with a smaller id; who stayed has no near copy that stayed.
    assert all(max(alike(lines[i], lines[j]) for j in lines if j < i) > 0.7 for i in lines if i not in kept)
    ids = sorted(kept)
    assert not [(i, j) for k, i in enumerate(ids) for j in ids[:k] if alike(kept[i], kept[j]) >= 0.88]
    words = lambda rs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rs)
    assert abs(words(seen[3]) - words(seen[2])) <= 20
    m = pieces.model(public_tokenizers.path("piece_bpe_32k.model")).library
    assert sorted(str((r["doc_id"], list(r["ids"]))) for r in seen[4]) == sorted(str((r["doc_id"], m.encode(r["text"]))) for r in seen[3])
    run = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(str, run)) == sorted(str(r) for r in docs.collect())


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids"] and out.count() > 0
