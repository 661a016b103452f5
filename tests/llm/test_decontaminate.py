import random
import re

from leafscan.llm import decontaminate as D


def words(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def grams(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def similarity(a, b):
    a, b = grams(a), grams(b)
    weigh = lambda s: sum(sum(map(len, g)) for g in s)
    return weigh(a & b) / weigh(a | b) if a | b else 0.0


def slow(docs, items):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, q in items:
            v = words(q)
            if len(v) < 5:
                continue
            best = max(((similarity(w[s : s + len(v)], v), -s) for s in range(max(1, len(w) - len(v) + 1))), default=(0, 0))
            if best[0] >= 0.8 and best > out.get((d, i), ((0, 0),))[0]:
                out[d, i] = (best, len(v))
    return {k: (round(b[0], 9), -b[1], n) for k, (b, n) in out.items()}


def test_equals_all_windows(spark):
    random.seed(6)
    pool = [f"{c}{i}" for c in "abé" for i in range(60)]
    items = [(i, " ".join(random.choices(pool, k=random.choice([5, 20, 20, 33, 50])))) for i in range(12)] + [(90, "too short"), (91, None)]
    items.append((92, items[1][1]))
    docs = [(0, None), (1, ""), (2, items[0][1]), (3, items[3][1].upper().replace(" ", ", "))]
    for d in range(10, 60):
        body = random.choices(pool, k=random.randint(0, 150))
        q = words(items[d % 12][1])
        if d % 3:
            for _ in range(d % 4):
                q[random.choice([0, 1, -1, -2])] = "changed"
            at = random.randint(0, len(body))
            body = body[:at] + q + body[at:]
        docs.append((d, " ".join(body)))
    spark_docs = spark.createDataFrame([(*x, 1) for x in docs + docs[-3:]], "doc_id long, text string, n int")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word, r.n_words) for r in D.find(spark_docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = slow(docs, items)
    assert got == want and len(want) > 20
    left = {r.doc_id for r in D.remove(spark_docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.find(none, items).count() == 0
    assert D.find(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), items.limit(0)).count() == 0
