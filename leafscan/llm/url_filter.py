"""URL filters by a Bloom filter cascade.

The keys that could ever be asked for are known: every host suffix with every path prefix of a listed length,
over all urls of the corpus. Level one of a cascade encodes the listed keys; level two the keys of that universe
which level one lets through wrongly; level three the listed keys that level two catches, and so on until a
level lets nothing through wrongly. A key is listed if the first level that rejects it is an even one
(counting from one) or, at an odd number of levels, if none does, so membership is exact over the universe, and urls are judged without a join.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: (host, path) rules of the production query, with their verdicts.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Hosts listed as bad; a host and its subdomains are blocked where no rule says otherwise.
LISTED = tuple(f"{n}.example.{t}" for n in ("adult-x", "spam-farm", "cheap-pills", "ads-track", "casino-win", "free-bets") for t in ("com", "net", "org"))


def parse(url):
    """Host and path columns of a url column; null, or without ://, both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def candidates(host, path, lengths):
    """All keys a listed key could equal: longest first, of equal lengths the longer host first."""
    parts = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))

    def with_prefix(n):
        return F.transform(hosts, lambda h: F.struct((-F.length(h) - n).alias("l"), (-F.length(h)).alias("lh"), F.concat(h, F.substring(path, 1, n)).alias("key")))

    none = F.array().cast("array<struct<l:int,lh:int,key:string>>")
    keys = [F.when(F.length(path) >= n, with_prefix(n)).otherwise(none) for n in sorted(lengths)]
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(F.flatten(F.array(*keys))), lambda x: x["key"]))


def _mix(x, salt):
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _positions(h1, h2, level, bits, hashes):
    a, b = _mix(h1, 2 * level), _mix(h2, 2 * level + 1) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [(a + np.uint64(j) * b) % np.uint64(bits) for j in range(hashes)]


def _passes(h1, h2, level, words):
    ok, (bits, hashes, data) = np.ones(len(h1), bool), words
    for p in _positions(h1, h2, level, bits, hashes):
        ok &= (data[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0
    return ok


def member(h1, h2, levels):
    """Whether keys, as two uint64 hashes, are listed."""
    inside, open_ = np.zeros(len(h1), bool), np.ones(len(h1), bool)
    for i, level in enumerate(levels):
        ok = _passes(h1, h2, i, level)
        inside[open_ & ~ok] = i % 2 == 1
        open_ &= ok
    inside[open_] = len(levels) % 2 == 1
    return inside


class Cascade:
    """Exact membership of `listed` over `universe` (h1, h2 long columns: hashes of distinct keys).

    Level one is about 1.44 log2(universe / listed) bits a listed key, and lets through about 1.4 wrong keys a
    listed key whatever the universe's size; the rest is geometric. So all that is gathered and broadcast is
    bounded by the list: max_bytes is checked before, and above it building fails with OverflowError, for which
    filter_urls takes a shuffled join in its place.
    """

    def __init__(self, universe: DataFrame, listed: DataFrame, max_bytes: int = common.BROADCAST_BYTES):
        n, s = listed.count(), universe.count()
        self.levels = []
        if not n:
            return
        bits, hashes = self._size(n, min(0.5, n * math.sqrt(2) / max(1, s)))
        if bits // 8 + 16 * n > max_bytes:
            raise OverflowError("the listed keys need more than max_bytes")
        ins = self._gather(listed)
        self.levels.append(self._encode(*ins, 0, bits, hashes))
        test = self._test(universe.sparkSession, self.levels[0])
        wrong = universe.where(test("h1", "h2")).join(listed, ["h1", "h2"], "left_anti")
        if 16 * (many := wrong.count()) > max_bytes:
            raise OverflowError(f"{many} wrong keys pass level one")
        outs = self._gather(wrong)
        while len(outs[0]):
            i = len(self.levels)
            ins, outs = outs, ins
            self.levels.append(self._encode(*ins, i, *self._size(len(ins[0]), 0.5)))
            ok = _passes(*outs, i, self.levels[-1])
            outs = outs[0][ok], outs[1][ok]
            if i > 500:
                raise ArithmeticError("two keys have equal hashes")

    @staticmethod
    def _size(n, p):
        bits = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2 / 64) * 64)
        return bits, min(24, max(1, round(bits / n * math.log(2))))

    @staticmethod
    def _gather(df):
        t = df.select("h1", "h2").toArrow()
        return tuple(t[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))

    @staticmethod
    def _encode(h1, h2, level, bits, hashes):
        data = np.zeros(bits // 64, np.uint64)
        for p in _positions(h1, h2, level, bits, hashes):
            np.bitwise_or.at(data, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        return bits, hashes, data

    @staticmethod
    def _test(spark, words):
        shared = spark.sparkContext.broadcast(words)

        @F.pandas_udf("boolean")
        def test(h1: pd.Series, h2: pd.Series) -> pd.Series:
            return pd.Series(_passes(h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64), 0, shared.value))

        return test


def _hashes(key):
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def filter_urls(pages: DataFrame, rules=RULES, listed=LISTED, id_column: str = "page_id", max_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    rules are (host, path, verdict): a rule fits its host and all subdomains where the url's path starts with
    the rule's; the longest (host and path together, then host alone; block before allow) wins. Without a rule,
    urls of listed hosts and their subdomains are blocked, others allowed. Null urls, and urls without ://,
    have an empty host and path, fit nothing and are allowed. Repeated rows and ties are kept as they are;
    other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    sets = {"block": sorted({h + p for h, p, v in rules if v == "block"}), "allow": sorted({h + p for h, p, v in rules if v == "allow"}), "listed": sorted(set(listed))}
    lengths = {len(p) for _, p, _ in rules} | {0}
    host, path = parse(F.col("url").cast("string"))
    urls = common.materialise(pages.select(F.col(id_column), host.alias("host"), path.alias("path")), "urls")
    urls = urls.withColumn("keys", candidates(F.col("host"), F.col("path"), lengths))
    h1, h2 = _hashes(F.col("key"))
    universe = common.materialise(urls.select(F.explode("keys").alias("key")).distinct().select(h1.alias("h1"), h2.alias("h2")), "universe")
    cascades = {}
    for name, keys in sets.items():
        table = spark.createDataFrame([(k,) for k in keys], "key string").select(h1.alias("h1"), h2.alias("h2"))
        try:
            cascades[name] = Cascade(universe, table, max_bytes).levels
        except OverflowError:
            return _by_join(spark, urls, sets, id_column)
    shared = spark.sparkContext.broadcast(cascades)

    @F.pandas_udf("array<byte>")
    def judge(a: pd.Series, b: pd.Series) -> pd.Series:
        sizes = a.map(len).to_numpy()
        empty = np.zeros(0, np.int64)
        x, y = (np.concatenate([empty, *s]).astype(np.int64).view(np.uint64) for s in (a, b))
        marks = sum(member(x, y, shared.value[name]).astype(np.int8) << i for i, name in enumerate(("block", "allow", "listed"))) if len(x) else empty
        return pd.Series(np.split(marks, np.cumsum(sizes)[:-1])) if len(sizes) else pd.Series([], dtype=object)

    first = F.transform("keys", lambda k: _hashes(k)[0])
    second = F.transform("keys", lambda k: _hashes(k)[1])
    return _verdicts(urls.withColumn("marks", judge(first, second)), id_column)


def _verdicts(urls, id_column):
    marked = urls.withColumn("hits", F.arrays_zip("keys", "marks"))
    ruled = marked.withColumn("hit", F.get(F.filter("hits", lambda x: x["marks"].bitwiseAND(F.lit(3)) > 0), F.lit(0)))
    is_listed = F.exists("hits", lambda x: x["marks"].bitwiseAND(F.lit(4)) > 0)
    verdict = F.when(F.col("hit").isNotNull(), F.when(F.col("hit.marks").bitwiseAND(F.lit(1)) > 0, "block").otherwise("allow")).when(is_listed, "block").otherwise("allow")
    return ruled.select(id_column, "host", "path", F.col("hit.keys").alias("rule"), verdict.alias("verdict"))


def _by_join(spark, urls, sets, id_column):
    """The same for lists too long to broadcast: marks are joined to the distinct keys, then to the urls' keys."""
    marks = spark.createDataFrame([(k, 1 << i) for i, n in enumerate(("block", "allow", "listed")) for k in sets[n]], "key string, mark int").groupBy("key").agg(F.sum("mark").cast("byte").alias("mark"))
    rows = urls.withColumn("row", F.monotonically_increasing_id())
    rows = common.materialise(rows, "urls")
    hit = rows.select("row", F.posexplode("keys").alias("at", "key")).join(marks, "key").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "key", "mark"))).alias("found"))
    both = rows.drop("keys").join(hit, "row", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<at:int,key:string,mark:tinyint>>")))
    return _verdicts(both.withColumn("keys", F.col("found.key")).withColumn("marks", F.col("found.mark")), id_column)
