import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from leafscan.llm import sentencepiece_codec as S


@pytest.fixture(scope="module")
def codec():
    return S.Codec(S.default_model())


TEXTS = ["", " ", "   ", "a", " a", "a ", "  a  b ", "\n", "\n\n a", "a\n b\r\nc", "\t x\t", "▁a ▁", "Thé ñandú çà ß", "日本 語\u3000x", "😀😀 a", "<s> </s> <0x0A>", "aaaaaaaaaaaaaaaaaaaaaaa", "x" * 3000, ");\r { \r", "\x00\x01 z", "e\u0301"]


def test_agenda_equals_the_library(codec):
    random.seed(1)
    pool = ["the", "ing", "ation", " ", "  ", "\n", "é", "▁", "\r", "%%%", "Q", "0", "."]
    texts = TEXTS + ["".join(random.choice(pool) for _ in range(random.randint(1, 60))) for _ in range(500)]
    got = codec.encode(texts)
    want = codec.library.encode(texts, add_bos=True, add_eos=True)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == want
    assert codec.mismatches == 0
    assert codec.decode(got) == codec.library.decode(want)


def test_generations_keep_results(codec, monkeypatch):
    monkeypatch.setattr(S, "CACHE", 5)
    small = S.Codec(S.default_model())
    for _ in range(2):
        for t in TEXTS:
            assert np.frombuffer(small.encode([t])[0], "<u4").tolist() == small.library.encode(t, add_bos=True, add_eos=True)
    both = small.encode(TEXTS[::-1])
    assert [np.frombuffer(b, "<u4").tolist() for b in both] == small.library.encode(TEXTS[::-1], add_bos=True, add_eos=True)


def test_query_over_nulls_ties_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "a b", None), (3, "a b", None)], "doc_id long, text string, ids string")
    rows = S.encode_decode(docs).collect()
    assert len(rows) == 5
    by = {(r.doc_id, r.decoded) for r in rows}
    assert by == {(1, ""), (2, ""), (None, "a b"), (3, "a b")}
    digest = {r.doc_id: r for r in S.encode_decode(docs, digest=True).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=S.default_model())
    ids = lib.encode("a b", add_bos=True, add_eos=True)
    assert digest[3].n_tokens == len(ids) and digest[3].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert S.encode_decode(docs.limit(0)).count() == 0
