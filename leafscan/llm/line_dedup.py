"""Line dedup by a suffix array over line IDs, in DataFrame functions only.

All lines of all documents, in order, are a sequence of line IDs with an end after each document. Suffixes are
ranked by distributed prefix doubling: the rank by d lines of a position and of the position d lines on give the
rank by 2d; a suffix that has become unique keeps its rank and takes no further part. Suffixes of equal rank at depth d
are the intervals of longest common prefix d or more of the suffix array. At depth min_lines an interval holds all places
of one run of lines: its first place stays and the later ones are deleted, and unions of deleted runs are
the later copies of the maximal repeated runs.

Ranks come from counts of distinct pairs (so a line that makes up a third of all is one row), added up along a
range partitioning; no window or group holds a class of suffixes.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

MIN_LINES = 2
#: In the pipeline a repeated run of one line is deleted too, where the line has so many words.
LONG_LINE = 50


def _running(counts: DataFrame) -> DataFrame:
    """counts (a, b, n; pairs distinct) with `before`: the sum of n over all smaller pairs."""
    ranged = common.materialise(counts.repartitionByRange("a", "b").withColumn("part", F.spark_partition_id()), "pairs")
    sums = ranged.groupBy("part").agg(F.sum("n").alias("all")).withColumn("start", F.coalesce(F.sum("all").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "start")
    inner = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("inner", inner).join(F.broadcast(sums), "part").select("a", "b", "n", (F.col("start") + F.col("inner")).alias("before"))


def line_table(docs: DataFrame, *extra) -> DataFrame:
    """(rid, ord, pos, a, b, and extra columns of `line`): a row for each line of each document that differs in doc_id or text from all others.

    rid names the document, ord is its place in the order that decides which copy is the first (null last), and a, b
    are two hashes, together the line's ID.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("ord"), F.xxhash64("doc_id", text).alias("rid"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return lines.select("rid", "ord", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("b"), "line").alias("b"), *extra).distinct()


def suffix_ranks(lines: DataFrame, depth: int | None = None) -> DataFrame:
    """(rid, ord, pos, rank, size, left): suffixes ranked by their first `depth` lines, or wholly where depth is None.

    rank is the number of suffixes that are smaller by those lines, size how many share the rank, left how many of the
    lines asked for the document has from there on (None: whether any copy differs, as null).
    """
    table = common.materialise(lines, "lines")
    ends = F.count("*").alias("lines")
    sizes = table.groupBy("rid").agg(ends)
    first = _running(table.groupBy("a", "b").agg(F.count("*").alias("n")))
    ranked = common.materialise(table.join(first, ["a", "b"]).join(sizes, "rid").select("rid", "ord", "pos", "lines", F.col("before").alias("rank"), F.col("n").alias("size")), "ranks")
    common.release(table)
    d = 1
    while depth is None or d < depth:
        step = d if depth is None else min(d, depth - d)
        active = ranked.where("size > 1")
        if depth is None and active.where(F.col("pos") + d < F.col("lines")).isEmpty():
            break
        ahead = ranked.select("rid", (F.col("pos") - step).alias("pos"), F.col("rank").alias("b"))
        pairs = active.join(ahead, ["rid", "pos"], "left").select("rid", "ord", "pos", "lines", F.col("rank").alias("a"), F.coalesce("b", F.lit(-1)).alias("b"))
        pairs = common.materialise(pairs, "active")
        run = common.materialise(_running(pairs.groupBy("a", "b").agg(F.count("*").alias("n"))), "runs")
        base = run.groupBy("a").agg(F.min("before").alias("base"))
        new = run.join(base, "a").select("a", "b", (F.col("a") + F.col("before") - F.col("base")).alias("rank"), F.col("n").alias("size"))
        moved = pairs.join(new, ["a", "b"]).select("rid", "ord", "pos", "lines", "rank", "size")
        old = ranked
        ranked = common.materialise(moved.union(ranked.where("size = 1")), "ranks")
        common.release(old, pairs, run)
        d += step
    return ranked


def later_long_lines(docs: DataFrame, long_line: int) -> DataFrame:
    """(rid, pos): lines of long_line words or more that have an earlier copy; the members of a line's rank at depth one."""
    words = F.size(F.array_remove(F.split("line", r"\s+"), ""))
    lines = common.materialise(line_table(docs, (words >= long_line).alias("long")).where("long"), "long")
    firsts = lines.groupBy("a", "b").agg(F.min(F.struct("ord", "rid", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return lines.join(firsts, ["a", "b"]).where(F.struct("ord", "rid", "pos") > F.col("first")).select("rid", "pos")


def later_runs(docs: DataFrame, min_lines: int = MIN_LINES, long_line: int | None = None) -> DataFrame:
    """(rid, runs array of (from, to)): for each document the runs of lines to delete, apart and in order."""
    ranks = suffix_ranks(line_table(docs), min_lines)
    members = ranks.where((F.col("size") > 1) & (F.col("pos") + min_lines <= F.col("lines"))).select("rank", "ord", "rid", "pos")
    firsts = members.groupBy("rank").agg(F.min(F.struct("ord", "rid", "pos")).alias("first"))
    later = members.join(firsts, "rank").where(F.struct("ord", "rid", "pos") > F.col("first"))
    covered = later.select("rid", F.explode(F.sequence(F.col("pos"), F.col("pos") + (min_lines - 1))).alias("pos"))
    if long_line is not None:
        covered = covered.union(later_long_lines(docs, long_line))
    covered = covered.distinct()
    islands = covered.withColumn("island", F.col("pos") - F.row_number().over(W.partitionBy("rid").orderBy("pos")))
    runs = islands.groupBy("rid", "island").agg(F.min("pos").alias("from"), (F.max("pos") + 1).alias("to"))
    return runs.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_line: int | None = None) -> DataFrame:
    """docs with _l_text, _l_lines, _l_removed and _l_runs: the text without later copies, and counts.

    Lines end at line feeds; an empty or null text is one empty line. A run of min_lines lines or more that also begins at
    an earlier place (smaller doc_id, or earlier in the same document; null doc_ids come last, rows of one doc_id
    in the order of a hash) is deleted, and with long_line a single such line of so many words or more; what is repeated is judged on the input. Rows equal in doc_id and text are one
    document and get the same result. Other columns are passed through; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    runs = common.materialise(later_runs(docs, min_lines, long_line).select(F.col("rid").alias("_l_rid"), F.col("runs").alias("_l_r")), "later")
    rows = docs.withColumn("_l_rid", F.xxhash64("doc_id", text)).join(runs.hint("merge"), "_l_rid", "left").withColumn("_l_all", F.split(text, "\n"))
    none = F.array().cast("array<struct<from:int,to:int>>")
    r, n = F.coalesce("_l_r", none), F.size("_l_all")
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size(r)),
            lambda i: F.slice("_l_all", F.coalesce(F.get(r, i - 1)["to"], F.lit(0)) + 1, F.greatest(F.lit(0), F.coalesce(F.get(r, i)["from"], n) - F.coalesce(F.get(r, i - 1)["to"], F.lit(0)))),
        )
    )
    removed = F.aggregate(r, F.lit(0), lambda s, x: s + x["to"] - x["from"])
    out = rows.select(*docs.columns, F.when(F.col("_l_r").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("_l_text"), n.cast("long").alias("_l_lines"), removed.cast("long").alias("_l_removed"), F.size(r).cast("long").alias("_l_runs"))
    return out


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
grams AS (
  SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS line2 FROM lines),
later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, pos) AS r FROM grams WHERE line2 IS NOT NULL) WHERE r > 1),
gone AS (SELECT doc_id, pos FROM later UNION SELECT doc_id, pos + 1 FROM later),
runs AS (SELECT doc_id, count(*) AS n_runs FROM gone g WHERE NOT EXISTS (SELECT 1 FROM gone h WHERE h.doc_id = g.doc_id AND h.pos = g.pos - 1) GROUP BY doc_id)
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(any_value(r.n_runs), 0) AS n_runs,
       md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_md5
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos LEFT JOIN runs r ON l.doc_id = r.doc_id GROUP BY l.doc_id"""
