import random

import numpy as np

from leafscan.llm import quality as Q


def corpus(seed=1, n=400):
    random.seed(seed)
    pool = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = random.choices(pool, k=random.randint(20, 200))
        text = " ".join(w + random.choice(["%%%", "$$$"]) for w in words) if bad else " ".join(words) + "."
        docs.append((i, text, "en", f"site{i % 7}" if i % 3 else "big/part", "clash"))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    return docs, labels


DOCS = "doc_id long, text string, lang string, source string, score string"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy_and_posteriors(spark):
    docs, labels = corpus()
    got = {r.doc_id: r for r in Q.classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert len(got) == len(docs)
    unseen = [i for i, *_ in docs if i % 2]
    assert sum(got[i].keep == (i % 5 != 0) for i in unseen) / len(unseen) > 0.98
    assert all(0 <= v <= 1 for r in got.values() for v in (r.host_posterior, r.path_posterior, r.score))
    assert (got[0].host, got[0].path, got[1].host, got[1].path) == ("big", "part", "site1", "en")


def test_sparse_sites_shrink_and_bad_sites_sink(spark):
    random.seed(2)
    ok = lambda: "plain words of a text " * 8
    bad = lambda: "%%% $$$ &&& " * 8
    docs = [(i, bad() if i % 10 else ok(), "en", "farm", "") for i in range(200)] + [(1000 + i, ok() if i % 10 else bad(), "en", "press", "") for i in range(200)]
    docs += [(3000 + i, ok(), "en", f"s{i}", "") for i in range(20)]
    labels = [(d, int(t.startswith("plain")), 0) for d, t, *_ in docs]
    got = {r.doc_id: r for r in Q.classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert got[1].host_posterior < 0.3 < 0.7 < got[1001].host_posterior
    assert got[1].host_posterior < got[3000].host_posterior < got[1001].host_posterior  # a single document stays near the prior


def test_odd_rows(spark):
    docs = [(1, None, None, None, ""), (2, "", "en", "a", ""), (None, "x" * 100000, "en", "a/", ""), (4, "a b", "en", "a", ""), (4, "a b", "en", "a", "")]
    d, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)
    for labels in (none, spark.createDataFrame([(4, 1, 0), (4, 1, 0), (None, 0, 0), (2, None, 0)], LABELS), spark.createDataFrame([(4, 1, 0), (2, 0, 0)], LABELS)):
        rows = Q.classify(d, labels).collect()
        assert len(rows) == 5 and not any(np.isnan(r.score) for r in rows)
    assert Q.keep_good(d, none).columns == d.columns
    assert Q.classify(d.limit(0), none).count() == 0
