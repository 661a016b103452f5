"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

Texts are lower-cased words (letters and digits) and their shingles of five. A window of a document has as many
words as the benchmark item that it may hold; only windows that share a shingle with such an item are
formed, as any other has similarity 0. A window's SimHash is looked up in a multi-index of the items' SimHashes: eight
blocks of eight bits, each with all values that differ in at most two bits, which finds every fingerprint within
23 bits. Each found pair is then verified exactly: similarity is the weight of the shared shingles over that of all
shingles of the two, a shingle weighing its number of characters.
"""

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, THRESHOLD, BLOCK_RADIUS = 5, 0.8, 2
RADIUS = 8 * (BLOCK_RADIUS + 1) - 1

_LANES = 0x0001000100010001


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _explode_shingles(df: DataFrame, w: str, *keep: str) -> DataFrame:
    """keep, pos, s, len: a row for each shingle; len is its weight."""
    named = df.select(*keep, *[F.slice(F.col(w), F.lit(i + 1), F.greatest(F.lit(0), F.size(w) - (SHINGLE - 1))).alias(f"w{i}") for i in range(SHINGLE)])
    rows = named.select(*keep, F.posexplode(F.arrays_zip(*[f"w{i}" for i in range(SHINGLE)])).alias("pos", "t"))
    parts = [F.col(f"t.w{i}") for i in range(SHINGLE)]
    return rows.select(*keep, "pos", F.xxhash64(*parts).alias("s"), sum((F.length(x) for x in parts), F.lit(0)).alias("len"))


def _lane_sums(weight: Column) -> list[Column]:
    """Sixteen sums, each of four counters of 16 bits: counter i of sum j is for bit 16 i + j."""
    return [F.sum(F.shiftrightunsigned("s", j).bitwiseAND(F.lit(_LANES)) * weight).alias(f"l{j}") for j in range(16)]


def _majority(total: Column) -> Column:
    """The fingerprint: bits whose counter is over half of total. Counters stay under 2^13."""
    bias = (F.lit(16383) - F.floor(total / 2)).cast("long") * F.lit(_LANES)
    fp = F.lit(0).cast("long")
    for j in range(16):
        high = (F.col(f"l{j}") + bias).bitwiseAND(F.lit(0x4000400040004000))
        fp = fp.bitwiseOR(F.shiftleft(F.shiftrightunsigned(high, 14), j))
    return fp


def _simhashes(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fp, and `set`: the distinct shingles with their weights. Weights are scaled down where a window is long."""
    totals = shingles.groupBy(*keys).agg(F.sum("len").alias("all"))
    scaled = shingles.join(totals, keys).withColumn("w", F.greatest(F.lit(1), F.floor(F.col("len") * 8000 / F.greatest(F.lit(8000), F.col("all")))))
    sums = scaled.groupBy(*keys).agg(*_lane_sums(F.col("w")), F.sum("w").alias("w"), F.collect_set(F.struct("s", "len")).alias("set"))
    return sums.select(*keys, _majority(F.col("w")).alias("fp"), "set")


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)).cast("int")


def _weight(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda a, x: a + x["len"])


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): each item's most similar window in each document.

    Rows appear where the similarity reaches the threshold; of equal windows the first is named. A document shorter
    than an item is one window. Items of fewer than five words have no shingle and are never found; null and
    empty texts hold nothing. Rows equal in doc_id and text are one document, rows of one doc_id with other texts
    are searched each and the best match is given; null doc_ids are searched and reported as null. Equal items are found
    each. Other columns are ignored; an empty table gives no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") >= SHINGLE).dropDuplicates(["item_id", "w"])
    items = common.materialise(items.select("item_id", F.size("w").alias("n"), "w", F.xxhash64("w").alias("iid")), "items")
    shingles = _explode_shingles(items, "w", "item_id", "iid", "n")
    known = common.materialise(shingles.groupBy("s", "n").agg(F.count("*").alias("c")).drop("c"), "known")
    # what is broadcast is judged by its own size: distinct shingles, the index (1 + 8 + 28 values a block, eight blocks), sets
    many = items.agg(F.count("*").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    sizes = {"known": known.count() * 32, "index": many["items"] * 8 * 37 * 48, "sets": many["items"] * 64 + many["words"] * 32}
    hinted = lambda df, what: F.broadcast(df) if sizes[what] <= common.BROADCAST_BYTES else df

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("rid"), text.alias("text"))
    cut_up = rows.select("rid", words(F.col("text")).alias("w")).withColumn("size", F.size("w"))
    hits = _explode_shingles(cut_up, "w", "rid", "size").join(hinted(known, "known"), "s").select("rid", "size", "n", "pos")
    last = F.greatest(F.lit(0), F.col("size") - F.col("n"))
    starts = F.sequence(F.least(last, F.greatest(F.lit(0), F.col("pos") - F.col("n") + SHINGLE)), F.least(last, F.col("pos")))
    windows = hits.select("rid", "n", F.explode(starts).alias("start")).distinct()
    spots = common.materialise(windows.groupBy("rid").agg(F.collect_list(F.struct("n", "start")).alias("spots")), "spots")

    # texts are shuffled, not their words, which take twice the room; and by the same plan at every size
    held = rows.join(spots.hint("merge"), "rid").dropDuplicates(["rid", "doc_id"]).withColumn("w", words(F.col("text")))
    cut = held.select("rid", "doc_id", "w", F.explode("spots").alias("x")).select("rid", "doc_id", F.col("x.n").alias("n"), F.col("x.start").alias("start"), F.slice("w", F.col("x.start") + 1, F.col("x.n")).alias("w"))
    keys = ["rid", "doc_id", "n", "start"]
    prints = common.materialise(_simhashes(_explode_shingles(cut, "w", *keys), keys), "windows")

    flips = [0, *(sum(1 << b for b in c) for k in range(1, BLOCK_RADIUS + 1) for c in combinations(range(8), k))]
    ikeys = ["item_id", "iid", "n"]
    item_prints = common.materialise(_simhashes(shingles, ikeys), "item_prints")
    index = item_prints.select("item_id", "n", F.col("fp").alias("ifp"), F.col("set").alias("iset"), F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _block(F.col("fp"), i).alias("value")) for i in range(8)])).alias("b"))
    index = index.select("item_id", "n", "ifp", "b.block", F.explode(F.array(*[F.col("b.value").bitwiseXOR(F.lit(f)) for f in flips])).alias("value"))
    probes = prints.select("rid", "n", "start", "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _block(F.col("fp"), i).alias("value")) for i in range(8)])).alias("b")).select("rid", "n", "start", "fp", "b.block", "b.value")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp")))
    near = probes.join(hinted(index, "index"), ["n", "block", "value"]).where(distance <= RADIUS).select("rid", "n", "start", "item_id", distance.alias("hamming")).distinct()

    pairs = near.join(prints.select("rid", "doc_id", "n", "start", "set"), ["rid", "n", "start"]).join(hinted(item_prints.select("item_id", "n", F.col("set").alias("iset")), "sets"), ["item_id", "n"])
    shared = _weight(F.array_intersect("set", "iset"))
    scored = pairs.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (_weight(F.col("set")) + _weight(F.col("iset")) - F.col("shared"))).where(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("at"), "n", "hamming")).alias("m")
    return scored.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("m.at")).cast("long").alias("start_word"), F.col("m.n").cast("long").alias("n_words"), F.col("m.hamming").cast("long").alias("hamming"), F.col("m.similarity").alias("similarity"))


def remove(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs in which find() finds nothing; rows with a null doc_id go if their text holds an item."""
    marked = docs.withColumn("_d_rid", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    keyed = marked.select(F.col("_d_rid").alias("doc_id"), "text")
    bad = common.materialise(find(keyed, benchmark, threshold).select(F.col("doc_id").alias("_d_rid")).distinct(), "leaks")
    return marked.join(bad.hint("merge"), "_d_rid", "left_anti").select(*docs.columns)
