import random

import pytest

from leafscan.llm import line_dedup as L


def slow(docs, n):
    first, out = {}, {}
    lines = {d: (t or "").split("\n") for d, t in docs}
    for d in sorted(lines):
        for i in range(len(lines[d]) - n + 1):
            first.setdefault(tuple(lines[d][i : i + n]), (d, i))
    for d, ls in lines.items():
        gone = [False] * len(ls)
        for i in range(len(ls) - n + 1):
            if first[tuple(ls[i : i + n])] != (d, i):
                gone[i : i + n] = [True] * n
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = ("\n".join(x for x, g in zip(ls, gone) if not g), len(ls), sum(gone), runs)
    return out


def make(seed):
    random.seed(seed)
    docs = [(0, None), (1, ""), (2, "\n\n\n"), (3, "a\n" * 20), (4, "one")]
    for i in range(60):
        docs.append((10 + i, "\n".join(random.choice("abcdefgh") for _ in range(random.randint(1, 12)))))
    return docs + [(90, docs[-1][1])]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_equals_a_loop(spark, n):
    docs = make(n)
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, pos int")
    got = {r.doc_id: (r._l_text, r._l_lines, r._l_removed, r._l_runs) for r in L.dedup_lines(df, n).collect()}
    assert got == slow(docs, n)


def test_the_whole_suffix_array(spark):
    docs = make(8)[:25]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    ids = {(r.a, r.b): (r.a, r.b) for r in L.line_table(df).collect()}
    text = {}
    for r in L.line_table(df).orderBy("ord", "pos").collect():
        text.setdefault(r.ord, []).append(ids[r.a, r.b])
    ranks = {(r.ord, r.pos): (r.rank, r.size) for r in L.suffix_ranks(L.line_table(df)).collect()}
    suffixes = sorted((tuple(text[d][p:]), (d, p)) for d, p in ranks)
    for key, (d, p) in suffixes:
        assert ranks[d, p] == (sum(k < key for k, _ in suffixes), sum(k == key for k, _ in suffixes))


def test_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, "a\nb"), (5, "a\nb"), (5, "a\nb"), (6, "x\na\nb\ny")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r._l_text) for r in L.dedup_lines(df).collect()) == [(0, ""), (5, "a\nb"), (5, "a\nb"), (6, "x\ny")]
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_the_pipeline_deletes_later_copies_of_long_lines(spark, tmp_path):
    import corpus_pipeline as P

    passage, brief = " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"a\n{passage}\nb"), (2, f"c\n{passage}\nd"), (3, passage), (4, f"e\n{brief}"), (5, f"{brief}\nf"), (6, f"{passage}\n{passage}\ng")]
    got = {r.doc_id: r.text for r in P.line_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()}
    assert got == {1: rows[0][1], 2: "c\nd", 3: "", 4: rows[3][1], 5: rows[4][1], 6: "g"}
