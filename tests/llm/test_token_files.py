import sys
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orbisect.llm import token_files as T

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1), st.just(2**60 - 1)), max_size=700), st.sampled_from([16, 100, 256]))
def test_packing_round_trip(values, block):
    v = np.array(values, np.uint64)
    words, sizes = T.pack(v, block)
    assert sizes.sum() == len(words)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    assert (T.unpack(words, offsets, len(v), block) == v).all() if len(v) else not len(words)


def test_small_ids_share_words():
    assert len(T.pack(np.zeros(1024, np.uint64))[0]) <= 5
    assert len(T.pack(np.full(1024, 40_000, np.uint64))[0]) == -(-1024 // 3)


def test_memo_gives_the_librarys_ids(rows):
    texts = [t or "" for _, t, *_ in rows] + ["don't 'S it's. a.b,c x.", "H\u0331 e\u0301. E\u0301, I\u0307", "ΑΣ σ. 12,3. 4", "a <|endoftext|> b", "  two  spaces\t\ttabs\r\n"]
    memo = T.WordMemo(VOCABULARY, most=50)
    whole = Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)
    for _ in range(2):
        ids, sizes = memo(texts)
        assert sizes.tolist() == [len(e.ids) for e in whole]
        assert ids.tolist() == [i for e in whole for i in e.ids]


LETTERS = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha()]
#: Letters that composing or lowering changes in length, marks, stops, added tokens and spaces.
ODD = [c for c in LETTERS if len(unicodedata.normalize("NFC", c).lower()) > 1] + ["\u0307", "\u0301", "\u093c", "\u05bc", ".", ",", "'s", "<|endoftext|>", "\t", "\u2028", "\u3000", "1", "K", "\u212a", "ß", "Σ"]


@pytest.fixture(scope="module")
def both():
    return T.WordMemo(VOCABULARY, most=2000), Tokenizer.from_file(VOCABULARY)


def same(both, texts):
    ids, sizes = both[0](texts)
    whole = [e.ids for e in both[1].encode_batch(texts, add_special_tokens=False)]
    return [a.tolist() for a in np.split(ids, np.cumsum(sizes)[:-1])] == whole


def test_every_letter_before_a_stop(both):
    texts = [f"b{c}. {c}, {c}.x {c}" for c in LETTERS]
    assert same(both, texts)


@settings(deadline=None, max_examples=400, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.sampled_from(ODD + list("aBİ. ,\n")), st.characters(codec="utf-8")), max_size=30))
def test_odd_texts_give_the_librarys_ids(both, parts):
    assert same(both, ["".join(parts), "B" + "".join(parts) + "."])


def test_other_vocabularies_go_to_the_library(rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    memo, texts = T.WordMemo(path), [t or "" for _, t, *_ in rows]
    assert not memo.by_words and same((memo, Tokenizer.from_file(path)), texts)


def expected(rows):
    t = Tokenizer.from_file(VOCABULARY)
    out, at = [], 0
    key = lambda r: (r[0] is not None, r[0] or 0)
    for i, text, *_ in sorted(rows, key=key):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_hold_all_ids_in_order(spark, rows, docs, clashing):
    got = T.token_files(docs, VOCABULARY).collect()
    want = expected(rows)
    assert len(got) == len(want)
    # Ids alone decide the order of distinct ids; equal ones follow their texts' hashes.
    single = {r[0] for r in want if sum(x[0] == r[0] for x in want) == 1}
    assert {tuple(r) for r in got if r[0] in single} == {r for r in want if r[0] in single}
    assert sorted(r[2:] for r in map(tuple, got)) == sorted(r[2:] for r in want)
    ends = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))
    assert sorted(map(str, T.token_files(clashing, VOCABULARY).collect())) == sorted(map(str, got))


def test_empty(empty):
    assert T.token_files(empty, VOCABULARY).collect() == []


def test_other_files_are_refused(tmp_path):
    (tmp_path / "x").write_bytes(b"0" * 100)
    with pytest.raises(ValueError):
        list(T.read_file(f"file://{tmp_path}/x"))
