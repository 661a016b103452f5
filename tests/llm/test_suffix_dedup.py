import hashlib
import random

import numpy as np

from leafscan.llm import suffix_dedup as S


def slow(docs, length=50):
    low = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            low[w] = min(low.get(w, d), d)
    out = {}
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if low[b[i : i + length]] < d:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest())
    return out


def make(seed, n=40):
    random.seed(seed)
    pool = ["the", "ing", "é", "zu", " ", "ab", "a", "\n"]
    passages = ["".join(random.choices(pool, k=60)) for _ in range(4)]
    docs = [(3, None), (4, ""), (5, "short"), (6, "a" * 300), (7, "b" + "a" * 120), (8, "ab" * 100), (9, "a" * 50), (10, "a" * 49)]
    for i in range(n):
        t = "".join(random.choices(pool, k=random.randint(5, 300)))
        for _ in range(random.randint(0, 3)):
            at, q = random.randint(0, len(t)), random.choice(passages)
            a = random.randint(0, 10)
            t = t[:at] + q[a : len(q) - random.randint(0, 10)] + t[at:]
        docs.append((20 + i, t))
    docs.append((90, docs[-1][1]))
    return docs


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for kinds, n in ((2, 500), (3, 2000), (200, 3000), (1, 90)):
        s = rng.integers(0, kinds, n).astype(np.uint8) + 1
        sa = S.suffix_array(s, 50)
        assert sorted(sa.tolist()) == list(range(n))
        b = s.tobytes()
        keys = [b[i : i + 50] for i in sa]
        assert keys == sorted(keys)


def test_equals_brute_force(spark, monkeypatch):
    for seed, group, array in ((1, 8 << 20, 2 << 20), (2, 1 << 13, 1 << 10)):
        monkeypatch.setattr(S, "GROUP", group)
        monkeypatch.setattr(S, "ARRAY", array)
        docs = make(seed)
        got = S.dedup(spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, h string, row int"), digest=True).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == slow(docs)
        assert len(got) == len(docs) and sum(r.n_removed for r in got) > 1000


def test_ties_nulls_and_nothing(spark):
    t = "0123456789" * 12
    rows = S.dedup(spark.createDataFrame([(1, t), (1, t), (1, t + "x"), (None, t)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 120), (1, 0), (1, 0), (1, 0)]
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_hot_anchors_and_empty_rows(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    long = " ".join(word() for _ in range(2 * S.CHUNK // 6 + 9000))
    assert len(long) > 2 * S.CHUNK
    cut = S.CHUNK - 40  # a repeat that lies across two pieces
    docs = [(1, long), (2, "head " + long[cut : cut + 200] + " tail"), (3, long[: S.CHUNK + 30][::-1] + long[2 * S.CHUNK - 100 :])]
    hot = "one and the same sixteen bytes"
    docs += [(10 + i, f"{word()} {word()} {word()} {word()} {hot} {word()} {word()} {word()} {word()} {i % 7}") for i in range(400)]
    empty = [(10_000 + i, ["", None][i % 2]) for i in range(100_000)]
    got = S.dedup(spark.createDataFrame(docs + empty, "doc_id long, text string"), digest=True).toPandas().set_index("doc_id")
    want = slow(docs)
    for d, x in want.items():
        assert tuple(got.loc[d]) == x
    assert len(got) == len(docs) + len(empty) and (got.loc[10_000:, "n_bytes"] == 0).all()


def test_split_and_numbers():
    b = np.array([900_000_007, 3, 3, 900_000_007])
    assert [(i, np.frombuffer(x[0], np.int64).tolist()) for i, x in S._split(b, np.arange(4))] == [(3, [1, 2]), (900_000_007, [0, 3])]
    row, doc = np.array([5, 1, 5, 5, -2]), np.array([1, 1, 2, 1, 9])
    assert S._numbers(row, doc).tolist() == [2, 1, 3, 2, 0]
    assert S._numbers(row[::-1], doc[::-1]).tolist() == [0, 2, 3, 1, 2]
