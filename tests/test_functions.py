import pytest
from pyspark.sql import functions as F

from leafscan.config import DIALECTS, ContractError
from leafscan.functions import charset, ctc, metrics
from leafscan.operators import segment


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_distances_and_rates(spark):
    lit = F.lit
    r = one(spark, d=metrics.edit_distance(lit("kitten"), lit("sitting")), a=metrics.accuracy(lit("ab"), lit("abcde")), b=metrics.accuracy(lit("hellp"), lit("hello")), c=metrics.cer(lit("x"), lit("")), e=metrics.cer(lit(""), lit("")), f=metrics.cer(lit("é"), lit("e")))
    assert (r.d, r.a, r.b, r.c, r.e, r.f) == (3, 40.0, 80.0, 1.0, 0.0, 1.0)
    for name, d in DIALECTS.items():
        both = one(spark, x=metrics.accuracy(lit(""), lit(""), d), y=metrics.accuracy(lit("a"), lit(""), d), z=metrics.accuracy(lit(None).cast("string"), lit("a"), d), third=metrics.accuracy(lit("ab"), lit("abc"), d), wide=metrics.accuracy(lit("😀a"), lit("a"), d))
        assert both.x == (100 if name == "go" else 0) and both.y == both.z == 0
        assert both.third == (66.67 if name in ("js", "rust") else pytest.approx(200 / 3))
        assert both.wide == (pytest.approx(33.33) if name == "js" else 50)
    assert one(spark, a=metrics.tile_count(lit(0)), b=metrics.tile_count(lit(1025))) == (1, 2)


def test_unsound_scores_raise(spark):
    nan = F.array(*[F.lit(float("nan"))] * 4)
    assert not one(spark, a=ctc.is_sound(nan, 2, 2)).a and not one(spark, a=ctc.is_sound(F.array(F.lit(1.0)), 2, 2)).a
    for scores, chars in ((nan, "a"), (F.array(*[F.lit(x) for x in (0.0, 0.0, 1.0)]), "a")):
        with pytest.raises(Exception, match="scores|beyond"):
            one(spark, a=ctc.greedy(scores, 2 if chars and scores is nan else 1, 2 if scores is nan else 3, chars))
    ties = F.array(F.lit(1.0), F.lit(5.0), F.lit(5.0))
    assert one(spark, a=ctc.argmax(ties)).a == 1


def test_charsets(spark):
    assert charset.resolve(None, " ab\r\n", "z") == " ab" and charset.resolve("q", " ab", "z") == "q"
    for bad in ((None, None, None), ("\n", None, None)):
        with pytest.raises(ContractError):
            charset.resolve(*bad)
    assert [(r.cls, r.ch) for r in charset.table(spark, "\r\n ab\n").collect()] == [(1, " "), (2, "a"), (3, "b")]
    assert [c.ch for c in one(spark, a=charset.index(F.lit(" é\n"))).a] == [" ", "é"]


def test_native_merge_equals_the_kernel(spark):
    import numpy as np

    from leafscan.operators import kernels

    rng = np.random.default_rng(9)
    rows, want = [], {}
    for p in range(25):
        profile = np.where(rng.random(200) < 0.45, rng.integers(0, 9, 200), 0)
        rows += [(p, y, int(v)) for y, v in enumerate(profile)]
        runs = kernels.line_runs(profile, 1)
        want[p] = kernels.merge_runs(runs, profile, 4, 3)
    prof = spark.createDataFrame(rows, "page int, y int, ink long")
    runs = segment.runs(prof, prof.select("page").distinct().withColumn("t", F.lit(1.0)))
    got = {}
    for r in segment.merged(prof, runs, 4, 3).orderBy("page", "line_no").collect():
        got.setdefault(r.page, []).append((r.r0, r.r1))
    assert got == want


def test_native_smoothing_equals_the_kernel(spark):
    import numpy as np

    from leafscan.operators import kernels

    profile = np.random.default_rng(2).integers(0, 50, 60)
    prof = spark.createDataFrame([(0, y, int(v)) for y, v in enumerate(profile)], "page int, y int, ink long")
    for how in ("true_k", "visited", "fixed"):
        for k in (1, 2, 3, 4, 5, 15):
            got = [r.s for r in segment.smooth(prof, k, how).orderBy("y").collect()]
            assert np.allclose(got, kernels.smooth(profile, k, how))
