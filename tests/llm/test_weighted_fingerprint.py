import hashlib
import random
import string

from leafscan.llm import weighted_fingerprint as S


def jaccard(a, b):
    from collections import Counter

    x, y = Counter((a or "").lower().split()), Counter((b or "").lower().split())
    every = x.keys() | y.keys()
    return sum(min(x[w], y[w]) for w in every) / max(1, sum(max(x[w], y[w]) for w in every))


def test_edited_texts_and_likeness(spark):
    random.seed(4)
    pool = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(random.choices(pool, k=random.randint(30, 900))), "z") for i in range(60)]
    rows += [(100, None, "z"), (101, "", "z"), (103, "É b", "z"), (104, "a\n\tB b", "z"), (105, rows[0][1], "z"), (105, rows[0][1], "z")]
    got = {r.doc_id: r for r in S.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string, rid string")).collect()}
    texts = {i: t or "" for i, t, _ in rows}
    ids = sorted(texts, reverse=True)
    assert sorted(got, reverse=True) == ids
    errors = []
    for at, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(at + 1) % len(ids)]]
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if len(t) > 100:
            errors.append(got[i].near_edited - jaccard(t, edited))
            assert abs(errors[-1]) < 0.3
    assert abs(sum(errors) / len(errors)) < 0.03
    assert got[105].fingerprint == got[0].fingerprint and got[100].fingerprint == got[101].fingerprint
    assert got[101].near_next == 1.0 and got[103].near_next == 0.0
    assert len({r.fingerprint for r in got.values()}) == len(got) - 2


def test_weights_matter_as_generalised_jaccard_says(spark):
    pairs = [(2 * i + s, " ".join(f"t{i}x{j} " * (3 if s else 1) for j in range(200))) for i in range(20) for s in (0, 1)]
    got = {r.doc_id: r.fingerprint for r in S.fingerprints(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    same = [sum(got[2 * i][8 * b : 8 * b + 8] == got[2 * i + 1][8 * b : 8 * b + 8] for b in range(64)) / 64 for i in range(20)]
    assert abs(sum(same) / 20 - 1 / 3) < 0.05


def test_one_heavy_word_weighs_what_it_counts(spark):
    pairs = [(2 * i + s, f"h{i} " * 1000 + " ".join(f"t{i}x{s}x{j}" for j in range(63))) for i in range(20) for s in (0, 1)]
    got = {r.doc_id: r.fingerprint for r in S.fingerprints(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    same = [sum(got[2 * i][8 * b : 8 * b + 8] == got[2 * i + 1][8 * b : 8 * b + 8] for b in range(64)) / 64 for i in range(20)]
    assert abs(sum(same) / 20 - 1000 / 1126) < 0.05


def test_one_and_no_document(spark):
    one = S.edited_fingerprints(spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].doc_id is None
    assert S.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _stages(spark):
    """{stage: bytes that it shuffled}."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}


def _shuffled(spark, rows):
    """Bytes shuffled while rows are fingerprinted, with no side small enough for a broadcast."""
    docs, old = spark.createDataFrame(rows, "doc_id long, text string"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    before = _stages(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(S.edited_fingerprints(docs).collect()) == len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    return sum(n for k, n in _stages(spark).items() if k not in before)


def test_texts_and_their_beginnings_are_shuffled_once(spark):
    random.seed(5)
    rows = [(i, " ".join("".join(random.choices(string.ascii_letters + string.digits, k=99)) for _ in range(500))) for i in range(60)]
    assert 1.3 < _shuffled(spark, rows) / sum(len(t) for _, t in rows) < 1.5


def test_samples_are_shuffled_once_as_own_and_once_as_next(spark):
    # a row has 256 bytes of samples of its text, as many of the edited one and 64 of a digest; to the document before go the first 256
    rows = [(i, f"a{i} b{i}") for i in range(2000)]
    assert 3 * 256 < _shuffled(spark, rows) / len(rows) < 4.5 * 256
