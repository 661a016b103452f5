"""Text metrics over all texts, against brute force."""

import __spark_entry__ as E


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_texts_beyond_ascii_are_measured(spark, tmp_path):
    texts = ["naïve café", "naive cafe", "Straße 東京", "東京 Strasse", "plain text", "plain test"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    turns = [(i, t, texts[(i + t) % 6]) for i in range(6) for t in (0, 1)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    run = lambda name: E.queries()[name](spark, str(tmp_path)).collect()
    pairs = {i: (texts[i], texts[i + 1]) for i in range(5)}
    far = {i: distance(*p) for i, p in pairs.items()}
    assert {r.item_id: r.distance for r in run("edit_distance_all")} == far
    share = {i: (1 - far[i] / max(map(len, p))) * 100 for i, p in pairs.items()}
    assert {r.item_id: r.accuracy for r in run("accuracy_all")} == {i: round(x, 6) for i, x in share.items()}
    assert all(abs(r.accuracy - share[r.item_id]) < 0.0051 for r in run("accuracy_rounded_all"))
    assert {r.item_id: r.cer for r in run("cer_all")} == {i: round(far[i] / len(p[1]), 6) for i, p in pairs.items()}
    (tiles,) = run("ab_by_tiles_all")
    assert tiles.n == 5 and abs(tiles.mean_b - sum(far[i] / len(p[0]) for i, p in pairs.items()) / 5) < 1e-6
    assert len(run("read_with_accuracy_all")) == 6
