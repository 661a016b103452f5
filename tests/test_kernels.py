import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafscan.config import DIALECTS, ContractError, Dialect
from leafscan.operators import kernels as K


def page(bands=29, gap=3, framed=False, width=800, band=40):
    h = 60 + band * bands + gap * bands
    p = np.full((h, width), 255, np.uint8)
    for i in range(bands):
        y = 30 + i * (band + gap)
        for j in range(30):
            p[y : y + band, 100 + 20 * j : 112 + 20 * j] = 0
    if framed:
        for side in (p[10:14, 10 : width - 10], p[h - 14 : h - 10, 10 : width - 10], p[10 : h - 10, 10:14], p[10 : h - 10, width - 14 : width - 10]):
            side[:] = 0
    return p


def mask(p):
    return K.binarise(p, Dialect())


@pytest.mark.parametrize("gap", [1, 2, 3, 4, 5])
def test_bands_are_lines(gap):
    found = K.boxes(mask(page(gap=gap)), Dialect())
    assert len(found) == 29 and [b[1] for b in found] == sorted(b[1] for b in found)


def test_no_gap_is_one_run_and_no_ink_is_none():
    assert len(K.line_runs(mask(page(gap=0)).sum(1), 1)) == 1
    assert K.boxes(np.zeros((50, 50), np.uint8), Dialect()) == []


@pytest.mark.parametrize("gap", [5, 12])
def test_wide_smoother(gap):
    assert len(K.boxes(mask(page(gap=gap)), Dialect(smooth="true_k", window=15, threshold="max", ratio=0.02))) == 29


def test_rules_go_and_clean_pages_stay():
    clean, framed = mask(page(4)), mask(page(4, framed=True))
    assert (K.suppress_rules(clean) == clean).all()
    left = K.suppress_rules(framed)
    assert left[12, 400] == 0 and left[100, 12] == 0
    rows = np.flatnonzero(clean.sum(1) > 0)
    assert (left.sum(1)[rows] >= 0.9 * clean.sum(1)[rows]).all()
    assert len(K.boxes(framed, Dialect())) == 4


def test_guard_keeps_a_page_of_bars():
    m = np.zeros((200, 900), np.uint8)
    m[10:190, 20:880] = 1
    assert (K.suppress_rules(m) == m).all()


@given(st.integers(1, 60), st.integers(1, 60), st.integers(0, 2**32), st.integers(1, 20))
@settings(max_examples=60, deadline=None)
def test_long_runs_equal_a_loop(h, w, seed, least):
    m = (np.random.default_rng(seed).random((h, w)) < 0.7).astype(np.uint8)
    want = np.zeros_like(m)
    for y in range(h):
        x = 0
        while x < w:
            e = x
            while e < w and m[y, e]:
                e += 1
            if e - x >= least:
                want[y, x:e] = 1
            x = max(e, x + 1)
    assert (K.long_runs(m, least) == want).all()


def test_published_runs():
    def merged(runs, fills, n):
        profile = np.zeros(n, int)
        for a, b, v in fills:
            profile[a:b] = v
        return K.merge_runs(runs, profile)

    r = [(20, 60), (62, 102), (150, 210), (260, 320)]
    assert merged(r, [(a, b, 300) for a, b in r] + [(60, 62, 5)], 400) == [(20, 102), (150, 210), (260, 320)]
    r = [(0, 20), (21, 41), (42, 62), (63, 83), (150, 190), (210, 250), (270, 310), (330, 370), (390, 430)]
    assert merged(r, [(a, b, 300) for a, b in r] + [(a, a + 1, 5) for a in (20, 41, 62)], 500) == [(0, 62), (63, 83), *r[4:]]
    r = [(10, 50), (100, 142), (144, 165), (200, 240), (260, 300)]
    assert merged(r, [(a, b, 300) for a, b in r], 400) == r
    r = [(4 * i, 4 * i + 2) for i in range(12)] + [(100, 124), (126, 150)] + [(200 + 60 * i, 250 + 60 * i) for i in range(3)]
    got = merged(r, [(a, b, 20 if b < 100 else 300) for a, b in r] + [(124, 126, 5)], 700)
    assert (100, 150) in got and all(b - a < 10 for a, b in got if a < 100)


def test_smoothing_formulas():
    flat = np.full(60, 300)
    assert K.smooth(flat, 3, "true_k")[0] == 200 and K.smooth(flat, 15, "true_k")[0] == 160
    assert K.smooth(flat, 3, "visited")[0] == 300
    for k in range(2, 13):
        for zeros, reaches in ((k, True), (k - 1, False)):
            s = K.smooth(np.r_[np.full(20, 9), np.zeros(zeros, int), np.full(20, 9)], k, "true_k")
            assert (s.min() == 0) == reaches


def test_tiles():
    assert len(K.tiles(np.zeros((100, 640), np.uint8))) == 1 < len(K.tiles(np.zeros((100, 641), np.uint8)))
    for w, white in ((3000, 1400), (5000, 2000), (4000, None)):
        line = np.zeros((100, w), np.uint8)
        if white:
            line[:, white : white + 60] = 255
        t = K.tiles(line)
        assert [a for a, _ in t[1:]] == [b for _, b in t[:-1]] and t[0][0] == 0 and t[-1][1] == w
        assert all(int((b - a) * 1.6) <= 1024 for a, b in t)
    assert K.tiles(np.zeros((0, 100), np.uint8)) == [(0, 100)] and K.tiles(np.zeros((100, 0), np.uint8)) == [(0, 0)]


def test_cuts():
    line = np.zeros((20, 1200), np.uint8)
    line[:, 900:960] = 255
    assert 900 <= K.cut_column(line, 0, 1000) <= 960
    assert K.cut_column(line, 0, 1200) == 1200 == K.cut_column(line, 0, 5000)
    line = np.zeros((20, 1200), np.uint8)
    line[:10, 950:953] = 255
    assert K.cut_column(line, 0, 1000) == 950
    assert K.cut_column(np.zeros((20, 1200), np.uint8), 0, 1000) == 880


def test_polarity():
    dense = np.full((60, 200), 255, np.uint8)
    dense[6:54, 20:180] = 0
    assert not K.is_dark(dense)
    short = np.zeros((8, 120), np.uint8)
    short[3:5, 10:110] = 255
    narrow = np.zeros((60, 8), np.uint8)
    narrow[10:50, 3:5] = 255
    for p in (short, narrow):
        assert K.is_dark(p) and (K.dark_on_light(K.dark_on_light(p)) == K.dark_on_light(p)).all()
    for shape in ((1, 1), (3, 2), (1, 3)):
        K.dark_on_light(np.zeros(shape, np.uint8))


def test_preprocess():
    assert (K.preprocess(np.full((40, 200), 255, np.uint8), Dialect()) == 1).all()
    g = K.preprocess(np.full((40, 200), 128, np.uint8), Dialect())
    assert np.allclose(g[0, 0, :, :800], 128 / 127.5 - 1)
    t = K.preprocess(np.full((50, 100), 200, np.uint8), Dialect())
    assert t.shape == (1, 1, 160, 1024) and t.dtype == np.float32 and (t[..., 320:] == 1).all() and (t[..., :320] < 1).all()
    assert K.preprocess(np.zeros((0, 10), np.uint8), Dialect()) is None and K.preprocess(np.zeros((10, 0), np.uint8), Dialect()) is None
    with pytest.raises(ContractError):
        K.preprocess(np.zeros((4, 4, 3), np.uint8), Dialect())


@pytest.mark.parametrize("name", DIALECTS)
def test_each_dialect_reads_the_drawn_page(name):
    d = DIALECTS[name]
    assert len(K.boxes(K.binarise(page(6, gap=12), d), d)) == 6


def test_ratio_must_make_sense():
    for bad in (0, -1, float("inf"), float("nan")):
        with pytest.raises(ContractError):
            Dialect(ratio=bad)


def test_resampling():
    g = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    for how in ("bilinear", "triangle", "bicubic", "lanczos3"):
        assert np.allclose(K.resize(g, 4, 3, how), g)
        assert np.allclose(K.resize(np.full((7, 9), 77, np.uint8), 5, 20, how), 77)
    edge = np.array([[0, 100]], np.uint8)
    assert np.allclose(K.resize(edge, 4, 1), [[0, 25, 75, 100]])  # fractions stay: 0.25 of 101 is 25.25
    assert np.allclose(K.resize(np.array([[0, 101]], np.uint8), 4, 1), [[0, 25.25, 75.75, 101]])
    assert np.allclose(K.resize(np.array([[0, 101]], np.uint8), 4, 1, "triangle"), [[0, 25, 76, 101]])
    stripes = np.tile(np.array([0, 200], np.uint8), 20)[None]
    assert (K.resize(stripes, 5, 1, "triangle")[0, 1:-1] == 100).all() and set(K.resize(stripes, 5, 1)[0]) <= {100.0}
    assert K.resize(np.array([[0, 0, 200, 200]], np.uint8), 8, 1, "lanczos3").max() > 205
    with pytest.raises(ContractError):
        K.resize(g, 4, 3, "nearest")
