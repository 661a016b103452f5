import random
import re

import numpy as np
import xxhash

from leafscan.llm import simhash_neardup as S


def slow(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def texts():
    random.seed(3)
    pool = [f"w{i}" for i in range(50)]
    out = [None, "", "  \t\n", "One", "one two", "ONE two three", "É é\u00a0x a b"]
    for _ in range(30):
        base = [random.choice(pool) for _ in range(random.randint(3, 900))]
        out.append(" ".join(base))
        for _ in range(3):
            base = base[:]
            base[random.randrange(len(base))] = random.choice(pool)
            out.append("  ".join(base))
    return out


def test_fingerprints_equal_a_slow_count():
    for t in texts():
        assert int.from_bytes(S.simhash_bytes(t), "big") == slow(t)


def test_components_equal_brute_force(spark):
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in S.near_duplicates(spark.createDataFrame(rows + rows[:2], "doc_id long, text string, fp string")).collect()}
    fps = {i: slow(t) for i, t, _ in rows}
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= 3 and label[a] > label[b]:
                    label[a], changed = label[b], True
    assert {i: (got[i].fp & (1 << 64) - 1, got[i].component_id) for i in fps} == {i: (fps[i], label[i]) for i in fps}


def test_grids_lose_no_pair():
    rng = np.random.default_rng(5)
    masks = [m & (1 << 64) - 1 for m in S.grids()]

    def unary(fp):
        odd = 0x5555555555555555
        return (fp | fp >> 1) & odd | ((fp & fp >> 1 & odd) << 1)

    for _ in range(3000):
        a = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(2))
        b = a
        for bit in rng.choice(64, int(rng.integers(0, 4)), replace=False):
            b ^= 1 << int(bit)
        assert any((unary(a) ^ unary(b)) & m == 0 for m in masks)


def test_empty_and_null_ids(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = S.near_duplicates(spark.createDataFrame([(None, "a b c"), (7, "a b c"), (None, "z z y")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 7), (7, 7)]
