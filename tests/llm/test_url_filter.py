import random

from leafscan.llm import url_filter as U

URLS = [None, "", "no scheme/en/", "http://", "http://a.net", "HTTP://A.NET/", "https://x.example.net/en/1?q#z", "https://x.example.net/en", "http://example.net/fr/", "http://www.example.com/de/5", "http://example.com/des", "http://q.example.org/fr/1", "http://org/fr/", "http://notexample.com/de/1", "http://casino-win.example.com/en/", "http://m.casino-win.example.com?x", "a://b://c.net/x", "http://net/", "http://net", "http://.net/", "http://É.Net/é?x", "http://x.net#/en/"]


def slow(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]
    best = None
    for h, p, v in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    bad = any(host == h or host.endswith("." + h) for h in U.LISTED)
    return host, path, best and best[0], best[1] if best else "block" if bad else "allow"


def test_equals_a_slow_filter(spark):
    random.seed(2)
    urls = URLS + [f"http://{random.choice(['a', 'b.c', 'www'])}.{random.choice(U.LISTED + ('example.net', 'example.org', 'w.org'))}{random.choice(['', '/', '/en/', '/fr/2', '/de/'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, keys string")
    want = {i: slow(u) for i, u in enumerate(urls)}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(pages).collect()} == want
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(pages, max_bytes=1).collect()} == want


def test_cascade_is_exact_with_many_keys(spark):
    from pyspark.sql import functions as F

    keys = spark.range(20000).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit("s"), "id").alias("h2"), "id")
    levels = U.Cascade(keys.select("h1", "h2"), keys.where("id % 10 = 3").select("h1", "h2")).levels
    t = keys.toPandas()
    got = U.member(t.h1.to_numpy().view("u8"), t.h2.to_numpy().view("u8"), levels)
    assert (got == (t.id % 10 == 3)).all() and len(levels) > 2


def test_empty_table(spark):
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
