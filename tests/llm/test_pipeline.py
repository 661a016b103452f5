import random

import corpus_pipeline as P
from test_decontaminate import slow as leaks
from test_line_dedup import slow as without_runs
from test_near_copies import near

from leafscan.llm import quality, sentencepiece_codec


def fixture():
    random.seed(11)
    pool = [f"{c}{i}" for c in "abc" for i in range(80)]
    items = [(i, " ".join(random.choices(pool, k=25))) for i in range(5)]
    docs, labels = [], []
    for i in range(160):
        lines = [" ".join(random.choices(pool, k=random.randint(8, 20))) for _ in range(random.randint(2, 5))]
        if i % 8 == 1:
            lines.insert(1, items[i % 5][1])
        if i % 9 == 2:
            lines += ["shared line one here", "shared line two here", "shared line three"]
        bad = i % 7 == 0
        text = "\n".join(" ".join(w + "%%%" for w in x.split()) if bad else x for x in lines)
        if i % 20 == 3:
            text = docs[-1][1] + " more"
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(not bad), 0))
    docs += [(500 + i, docs[5][1], "en", "s1", 0) for i in range(3)]
    return docs, labels, items


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, labels, items = fixture()
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, kinds).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}

    good = {r.doc_id for r in quality.classify(spark.createDataFrame(docs, kinds), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("keep").collect()}
    assert not {i for i, t, *_ in docs if "%%%" in t} & good and len(good) > 100
    kept = {d: v[0] for d, v in without_runs([(d, t) for d, t, *_ in docs if d in good], 2).items()}
    label = {d: d for d in kept}
    moved = True
    while moved:
        moved = False
        for a in kept:
            for b in kept:
                if label[a] > label[b] and near(kept[a], kept[b]):
                    label[a], moved = label[b], True
    stay = [(d, kept[d]) for d in kept if label[d] == d]
    bad = {d for d, _ in leaks(stay, items)}
    want = {d: t for d, t in stay if d not in bad}
    assert bad and len(stay) < len(kept)
    assert {d: r.decoded for d, r in got.items()} == want
    library = sentencepiece_codec.Codec(sentencepiece_codec.default_model()).library
    assert all(r.ids == library.encode(want[d], add_bos=True, add_eos=True) and r.n_tokens == len(r.ids) for d, r in got.items())


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, rid string, w int"
    docs = spark.createDataFrame([(1, None, None, None, None, "a", 1), (None, "", "en", "s", 0, "b", 2), (None, "x y z w v", "en", "s", 9, "c", 3), (None, "x y z w v", "en", "s", 9, "c", 3), (7, "x y z w v", "en", "s", 9, "d", 4), (7, "x y z w v", "en", "s", 9, "d", 4), (7, "another text of the id", "en", "s", 9, "e", 5)], kinds)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "p q r s t u")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        assert sorted(r.rid for r in out.collect()) == (["a", "d", "e"] if name == "near dedup" else ["a", "b", "c", "c", "d", "d", "e"]), name
