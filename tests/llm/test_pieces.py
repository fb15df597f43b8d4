import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from orbisect.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["hello   world\n\n\tfoo ﬁ ☃漢字 <0x41> <s> </s> " + "a" * 40, "a", "     ", "", "𝒳𝒴 é́ " * 20, "the theater of thermodynamics " * 20, "unbelievably" * 30, "▁▁ x▁y"]


@pytest.mark.parametrize("chunk", [16, 50, 333])
def test_chunks_give_the_librarys_ids(rows, chunk):
    m = P.model(PATH)
    for t in TEXTS + [t[:3000] for _, t, *_ in rows if t]:
        assert P.encode_in_chunks(m, t, chunk) == m.library.encode(t)


def test_products_are_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((4, 4)) < 0.3, P.NONE, rng.random((4, 4))) for _ in range(3))
    assert np.allclose(P.product(P.product(a, b), c), P.product(a, P.product(b, c)))


def unigram(tmp_path):
    """A unigram model written down, not trained."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.unk_id = P.UNIGRAM, 0
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = "identity", False, False
    m.normalizer_spec.escape_whitespaces = True
    rng = np.random.default_rng(4)
    names = ["<unk>", *"abc▁", "ab", "bc", "abc", "ca", "▁a", "▁ab", "cab", "aa", "bb▁"]
    for k, n in enumerate(names):
        m.pieces.add(piece=n, score=float(-rng.random() * 9), type=2 if not k else 1)
    path = tmp_path / "u.model"
    path.write_bytes(m.SerializeToString())
    return str(path), sentencepiece.SentencePieceProcessor(model_file=str(path))


def test_unigram_models_too(tmp_path):
    path, library = unigram(tmp_path)
    m, rng = P.Model(path), np.random.default_rng(8)
    for _ in range(30):
        t = "".join(rng.choice(list("abc x"), rng.integers(1, 200)))
        got = P.encode_in_chunks(m, t, 20)
        score = lambda ids: sum(m.scores.get(library.id_to_piece(i), m.unknown_score) for i in ids)
        assert got == library.encode(t) or score(got) == pytest.approx(score(library.encode(t)))


def test_documents(spark, docs, rows, clashing, empty):
    m = P.model(PATH)
    want = sorted(str((i, m.library.encode(t or ""))) for i, t, *_ in rows)
    for giant in (500, 10**9):
        got = P.encoded(docs, PATH, giant=giant, chunk=200)
        assert sorted(str((r.doc_id, list(r.ids))) for r in got.collect()) == want
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "ids"]
    back = P.decoded(got, PATH).collect()
    assert sorted(str((r.doc_id, r.text)) for r in back) == sorted(str((i, t or "")) for i, t, *_ in rows)
    assert P.encoded(empty, PATH).collect() == [] and P.digested(empty, PATH).collect() == []
    assert P.encoded(clashing, PATH, giant=500, chunk=200).count() == len(rows)


@pytest.mark.parametrize("giant", [500, P.GIANT])
def test_digests(spark, docs, rows, monkeypatch, giant):
    """n_ids, ids_crc32 and decoded_sha256 are those of the library's ids, whichever way a text goes."""
    monkeypatch.setattr(P, "GIANT", giant)
    m, want = P.model(PATH).library, []
    for i, t, *_ in rows:
        ids = m.encode(t or "")
        want.append(str((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(m.decode(ids).encode()).hexdigest())))
    assert sorted(str(tuple(r)) for r in P.digested(docs, PATH).collect()) == sorted(want)
