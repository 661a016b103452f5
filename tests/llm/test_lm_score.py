import random
from collections import Counter

import numpy as np

from leafscan.llm import lm_score as L


def corpus(n=300):
    random.seed(5)
    # words that follow each other in a fixed way, so that neighbours tell the word between
    chain = {i: [(i * 7 + 3) % 40, (i * 11 + 5) % 40] for i in range(40)}
    docs = []
    for i in range(n):
        w, out = random.randrange(40), []
        for _ in range(random.randint(30, 120)):
            out.append(f"w{w}")
            w = random.choice(chain[w])
        docs.append((i, " ".join(out), "x"))
    return docs


SCHEMA = "doc_id long, text string, score string"


def test_scores_are_normalised_and_prefer_what_fits(spark):
    docs = corpus(900)
    random.seed(6)
    for i in range(20):
        words = docs[i][1].split()
        random.shuffle(words)
        docs.append((2000 + i, " ".join(words), "x"))
    got = {r.doc_id: r for r in L.score(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert all(got[i].n_tokens == len(t.split()) for i, t, _ in docs)
    real, mixed = (np.mean([got[b + i].score for i in range(20)]) for b in (0, 2000))
    assert real > mixed + 0.15 and real > -np.log(40)
    assert all(abs(got[i].log_likelihood - got[i].score * got[i].n_tokens) < 1e-6 for i in range(20))


def model(of, share=None):
    """Numbers below len(of) in the given classes."""
    many = L.VOCABULARY - len(of)
    return L.Model([f"w{i}" for i in range(len(of))], np.r_[of, np.zeros(many, int)], np.r_[np.zeros(len(of)) if share is None else share, np.zeros(many)], np.ones(L.OUTPUTS), np.zeros(L.CELLS, np.float32))


def test_masked_sum_equals_a_loop():
    rng = np.random.default_rng(3)
    w = L.start_weights(rng.normal(0, 1, L.OUTPUTS))
    of = rng.integers(0, L.CLASSES, 50)
    m = model(of, -rng.random(50))
    vocab = L.Vocabulary({b"w%d" % i: i for i in range(50)})
    ids, sizes = L._ids(["w1 w2 w3 rare!", "", "w4"], vocab)
    got = L.score_ids(ids, w, m)
    tables, out, bias = L._parts(w.astype(float))
    want = []
    for at in np.flatnonzero(ids >= 0):
        h = np.tanh(sum(tables[k][m.rows(ids)[at + o]] for k, o in enumerate((-2, -1, 1, 2))))
        z = h @ out + bias
        i = ids[at]
        want.append(z[of[i] if i < 50 else L.CLASSES + 3] - np.log(np.exp(z).sum()) + (m.share[i] if i < 50 else 0))
    assert sizes.tolist() == [4, 0, 1] and np.allclose(got, want, atol=1e-3)
    # a probability of all classes that could stand there
    m = model(np.arange(L.CLASSES))
    every = [L.score_ids(np.where(np.arange(len(ids)) == 3, k, ids), w, m)[1] for k in [*range(L.CLASSES), *(L.VOCABULARY + (s << L.BITS) for s in range(L.SHAPES))]]
    assert abs(np.exp(every).sum() - 1) < 1e-3


def test_training_lowers_the_loss():
    rng = np.random.default_rng(1)
    ids = np.r_[[-1] * 2, np.tile(np.arange(10), 800), [-1] * 2].astype(np.int32)
    m, w = model(np.arange(10)), L.start_weights(np.zeros(L.OUTPUTS))
    before = L.score_ids(ids, w, m).mean()
    L.learn(w, m.rows(ids), m.classes(ids), rng.permutation(np.arange(2, len(ids) - 2)), [])
    assert L.score_ids(ids, w, m).mean() > before + 2


def test_counts_equal_brute_force(spark, monkeypatch):
    """Shares of all words, in the vocabulary and outside it."""
    texts = ["a b c a", "b zz\u00a0yy a", None, "a b c d-1 d-1 rare"]
    monkeypatch.setattr(L, "VOCABULARY", 2)
    m = L.vocabulary(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA))
    n = Counter(w.decode() for t in texts for w in (t or "").lower().encode().split())
    assert m.words == ["a", "b"]
    rare = {w: k for w, k in n.items() if w not in m.words}
    for w, k in rare.items():
        code = L._code(w) - 2
        shape, cell = code >> L.BITS, code & (L.CELLS - 1)
        assert abs(m.cells[cell] - np.log(k)) < 1e-3 and m.mass[L.CLASSES + shape] == sum(j for v, j in rare.items() if L._shape(v) == shape)


def test_every_word_is_learnt_from_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD", 5000)
    rows = corpus(60)
    docs = spark.createDataFrame(rows, SCHEMA)
    m = L.vocabulary(docs)
    tables, keep = [], L.common.materialise
    with monkeypatch.context() as patch:
        patch.setattr(L.common, "materialise", lambda df, tag: tables.append(keep(df, tag)) or tables[-1])
        L.train(docs, m)
    learnt = tables[0].where("w is not null").agg({"n": "sum", "shard": "max"}).first()
    assert learnt["sum(n)"] == sum(len(t.split()) for _, t, _ in rows) and learnt["max(shard)"] > 1
    one, many = ({r.doc_id: r.score for r in L.score(docs.repartition(k)).collect()} for k in (1, 7))
    assert max(abs(one[d] - many[d]) for d in one) < 1e-5


def test_odd_rows(spark):
    rows = L.score(spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "q " * 50000, "x"), (3, "q " * 50000, "x")], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 2), (1, 0), (2, 0), (3, 50000), (3, 50000)]
    assert all(np.isfinite(r.score) for r in rows) and L.score(spark.createDataFrame([], SCHEMA)).count() == 0
