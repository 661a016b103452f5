"""The registered queries of the page operators, over whole stand-in tables, with their twins in DuckDB's SQL."""

from pyspark.sql import functions as F

from ..config import DIALECTS
from ..functions import charset, ctc, metrics
from ..operators import assemble, grid, segment
from . import adapters as A

QUERIES, TWINS = {}, {}


def _with(*names: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(A.TWINS[n] for n in names)


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            TWINS[name or f.__name__] = sql
        return f

    return keep


# decoding

_COLLAPSED = "kept AS (SELECT vec_id, t, cls FROM (SELECT *, lag(cls, 1, -1) OVER (PARTITION BY vec_id ORDER BY t) AS before FROM path8) WHERE cls <> 0 AND cls <> before)"


@query(_with("steps8", "path8") + f", {_COLLAPSED} SELECT e.vec_id, coalesce(string_agg(substr('abcdefg', cls, 1), '' ORDER BY t), '') AS text FROM embeddings e LEFT JOIN kept k ON e.vec_id = k.vec_id GROUP BY e.vec_id")
def ctc_greedy_decode(spark, sf_dir):
    return A.logits8(spark, sf_dir).select("vec_id", ctc.greedy(F.col("logits"), 8, 8, A.CHARSET).alias("text"))


@query(_with("steps8", "path8") + " SELECT vec_id, t, cls::INT AS cls FROM path8")
def argmax_path(spark, sf_dir):
    return A.logits8(spark, sf_dir).select("vec_id", F.posexplode(ctc.path(F.col("logits"), 8, 8)).alias("t", "cls"))


@query(_with("steps8", "path8") + f", {_COLLAPSED} SELECT vec_id, t, cls::INT AS cls FROM kept")
def collapse_repeats(spark, sf_dir):
    path = A.logits8(spark, sf_dir).select("vec_id", ctc.path(F.col("logits"), 8, 8).alias("p"))
    steps = F.filter(F.transform("p", lambda c, i: F.struct(i.alias("t"), c.alias("cls"), F.coalesce(F.get("p", i - 1), F.lit(-1)).alias("b"))), lambda s: (s["cls"] != 0) & (s["cls"] != s["b"]))
    return path.select("vec_id", F.explode(steps).alias("s")).select("vec_id", "s.t", "s.cls")


@query("SELECT vec_id, (len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda v: isnan(v) OR isinf(v)))) AS sound FROM embeddings")
def logits_finite_check(spark, sf_dir):
    return A.logits8(spark, sf_dir).select("vec_id", ctc.is_sound(F.col("logits"), 8, 8).alias("sound"))


@query("SELECT i::INT AS cls, substr('abcdefg', i, 1) AS ch FROM (SELECT unnest(range(1, 8)) AS i)")
def charset_index(spark, sf_dir):
    return charset.table(spark, "\r\n" + A.CHARSET + "\n").select(F.col("cls").cast("int").alias("cls"), "ch")


@query("SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' AND strpos(' abcdefghijklmnopqrstuvwxyz', ch) = 0 GROUP BY ch")
def charset_oov(spark, sf_dir):
    left = F.translate("text", " abcdefghijklmnopqrstuvwxyz", "")  # only what the charset lacks becomes rows
    chars = A.table(spark, sf_dir, "documents").select(F.explode(F.split(left, "")).alias("ch")).where("ch <> ''")
    return chars.groupBy("ch").agg(F.count("*").alias("n"))


# profile to lines

_SMOOTH = {
    "visited": ("avg(ink) OVER (PARTITION BY page ORDER BY y ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)", 3),
    "true_k": ("sum(ink) OVER (PARTITION BY page ORDER BY y ROWS BETWEEN {h} PRECEDING AND {g} FOLLOWING) / {k}", 5),
    "fixed": ("sum(ink) OVER (PARTITION BY page ORDER BY y ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) / {k}", 4),
}


def _smoothed(how, k=None):
    text, default = _SMOOTH[how]
    k = k or default
    return "smoothed AS (SELECT page, y, ink, (" + text.format(h=k // 2, g=(k - 1) // 2, k=f"{k}.0") + ")::DOUBLE AS s FROM prof)"


for _how, _name in (("visited", "smooth_visited"), ("true_k", "smooth_true_k"), ("fixed", "smooth_fixed_divisor")):

    @query(_with("prof") + f", {_smoothed(_how)} SELECT page, y, round(s, 6) AS s FROM smoothed", _name)
    def _smooth(spark, sf_dir, how=_how):
        return segment.smooth(A.profile(spark, sf_dir), _SMOOTH[how][1], how).select("page", "y", F.round("s", 6).alias("s"))


@query(_with("prof") + " SELECT page, y, ink FROM prof")
def row_profile(spark, sf_dir):
    return A.profile(spark, sf_dir)


_MEAN = "limits AS (SELECT page, avg(s) FILTER (WHERE s > 0) * {r} AS t FROM smoothed GROUP BY page)"
_MAX = "limits AS (SELECT page, max(s) FILTER (WHERE s > 0) * {r} AS t FROM smoothed GROUP BY page)"
_RUNS = """runs AS (SELECT page, min(y)::INT AS r0, (max(y) + 1)::INT AS r1 FROM (
  SELECT p.page, p.y, p.y - row_number() OVER (PARTITION BY p.page ORDER BY p.y) AS island FROM prof p JOIN limits l ON p.page = l.page WHERE p.ink > l.t) GROUP BY page, island)"""


@query(_with("prof") + f", {_smoothed('visited')}, {_MEAN.format(r=0.05)} SELECT page, round(t, 6) AS t FROM limits")
def gap_threshold_mean(spark, sf_dir):
    return segment.threshold(segment.smooth(A.profile(spark, sf_dir), 3, "visited")).select("page", F.round("t", 6).alias("t"))


@query(_with("prof") + f", {_smoothed('true_k')}, {_MAX.format(r=0.02)} SELECT page, round(t, 6) AS t FROM limits")
def gap_threshold_max(spark, sf_dir):
    return segment.threshold(segment.smooth(A.profile(spark, sf_dir), 5, "true_k"), 0.02, "max").select("page", F.round("t", 6).alias("t"))


def _runs(spark, sf_dir, ratio):
    rows = A.profile(spark, sf_dir)
    return rows, segment.runs(rows, segment.threshold(segment.smooth(rows, 3, "visited"), ratio))


def _runs_sql(ratio):
    return _with("prof") + f", {_smoothed('visited')}, {_MEAN.format(r=ratio)}, {_RUNS}"


@query(_runs_sql(0.5) + " SELECT page, r0, r1 FROM runs")
def line_runs(spark, sf_dir):
    return _runs(spark, sf_dir, 0.5)[1]


_TYPICAL = """heights AS (SELECT page, r1 - r0 AS h FROM runs),
typical AS (SELECT page, greatest(1, CASE WHEN count(*) FILTER (WHERE h >= {m}) > 0 THEN (list(h ORDER BY h) FILTER (WHERE h >= {m}))[(count(*) FILTER (WHERE h >= {m})) // 2 + 1] ELSE (list(h ORDER BY h))[count(*) // 2 + 1] END)::INT AS typical FROM heights GROUP BY page)"""


@query(_runs_sql(0.5) + f", {_TYPICAL.format(m=4)} SELECT page, typical FROM typical")
def typical_height(spark, sf_dir):
    return segment.lists(_runs(spark, sf_dir, 0.5)[1]).select("page", segment.typical_height(F.col("runs"), 4).alias("typical"))


_MERGE = """numbered AS (SELECT r.page, r0, r1, lag(r1) OVER (PARTITION BY r.page ORDER BY r0) AS p1, row_number() OVER (PARTITION BY r.page ORDER BY r0) AS i, typical FROM runs r JOIN typical t ON r.page = t.page),
gaps AS (SELECT n.page, n.i, count(p.y) AS blank FROM numbered n LEFT JOIN prof p ON p.page = n.page AND p.y >= n.p1 AND p.y < n.r0 AND p.ink <= 0 GROUP BY n.page, n.i),
fold AS (
  SELECT page, i, 0 AS line_no, r0 AS a0, r1 AS a1 FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.page, n.i, CASE WHEN m.joins THEN f.line_no ELSE f.line_no + 1 END, CASE WHEN m.joins THEN f.a0 ELSE n.r0 END, n.r1
  FROM fold f JOIN numbered n ON n.page = f.page AND n.i = f.i + 1 JOIN gaps g ON g.page = n.page AND g.i = n.i,
  LATERAL (SELECT n.r0 - f.a1 <= 10 AND (g.blank = 0 OR (2 * least(f.a1 - f.a0, n.r1 - n.r0) <= n.typical AND greatest(f.a1 - f.a0, n.r1 - n.r0) >= {m})) AND n.r1 - f.a0 <= 2 * n.typical AS joins) m),
merged AS (SELECT page, line_no::INT AS line_no, min(a0)::INT AS r0, max(a1)::INT AS r1 FROM fold GROUP BY page, line_no)"""

for _name, _ratio in (("merge_runs", 0.05), ("merge_runs_inked", 0.5)):

    @query(_runs_sql(_ratio) + f", {_TYPICAL.format(m=4)}, {_MERGE.format(m=4)} SELECT * FROM merged", _name)
    def _merge(spark, sf_dir, ratio=_ratio):
        rows, found = _runs(spark, sf_dir, ratio)
        return segment.merged(rows, found, 10, 4)


@query(_runs_sql(0.5) + f", {_TYPICAL.format(m=4)}, {_MERGE.format(m=4)} SELECT page, (row_number() OVER (PARTITION BY page ORDER BY r0) - 1)::INT AS line_no, r0, r1 FROM merged WHERE r1 - r0 >= 4")
def height_filter(spark, sf_dir):
    rows, found = _runs(spark, sf_dir, 0.5)
    return segment.tall(segment.merged(rows, found, 10, 4), 4)


@query(_with("textgrid") + " SELECT page, y, ink, width FROM textgrid")
def text_profile(spark, sf_dir):
    return A.textgrid(spark, sf_dir)


_EMPTY = _with("digitgrid") + ", bands AS (SELECT page, count(*) FILTER (WHERE ink > 0) AS inked FROM digitgrid GROUP BY page) SELECT page FROM bands WHERE inked = 0"


@query(_EMPTY)
def empty_pages(spark, sf_dir):
    rows = A.digitgrid(spark, sf_dir)
    return segment.threshold(segment.smooth(rows, 1, "visited")).where("t is null").select("page")


# grids

_TURN = {2: ("7 - x", "y"), 3: ("7 - x", "7 - y"), 4: ("x", "7 - y"), 5: ("y", "x"), 6: ("7 - y", "x"), 7: ("7 - y", "7 - x"), 8: ("y", "7 - x")}
for _tag, (_x, _y) in _TURN.items():

    @query(_with("grid8") + f" SELECT page, ({_y})::INT AS y, ({_x})::INT AS x, g FROM grid8", f"orient_{_tag}")
    def _orient(spark, sf_dir, tag=_tag):
        return grid.orient(A.grid8(spark, sf_dir), tag, 8, 8)


_MEDIAN = """patches AS (SELECT page, g FROM grid8 WHERE x < 3 AND y < 3 UNION ALL SELECT page, g FROM grid8 WHERE x >= 5 AND y < 3
  UNION ALL SELECT page, g FROM grid8 WHERE x < 3 AND y >= 5 UNION ALL SELECT page, g FROM grid8 WHERE x >= 5 AND y >= 5),
medians AS (SELECT page, median(g)::DOUBLE AS median FROM patches GROUP BY page)"""


@query(_with("grid8") + f", {_MEDIAN} SELECT page, median FROM medians")
def corner_median(spark, sf_dir):
    return grid.corner_median(A.grid8(spark, sf_dir), 8, 8)


@query(_with("grid8") + f", {_MEDIAN} SELECT g.page, y, x, CASE WHEN median < 128 THEN 255 - g ELSE g END::INT AS g FROM grid8 g JOIN medians m ON g.page = m.page")
def polarity_invert(spark, sf_dir):
    return grid.polarity(A.grid8(spark, sf_dir), 8, 8)


@query(_with("grid8", "mask8") + " SELECT page, y, x, ink FROM mask8")
def binarise_flat(spark, sf_dir):
    return A.mask8(spark, sf_dir)


_ISLANDS = """islands AS (SELECT page, y, x, ink, x - row_number() OVER (PARTITION BY page, y, ink ORDER BY x) AS ix, y - row_number() OVER (PARTITION BY page, x, ink ORDER BY y) AS iy FROM mask8),
ruled AS (SELECT page, y, x, ink, (ink > 0 AND (count(*) OVER (PARTITION BY page, y, ink, ix) >= 4 OR count(*) OVER (PARTITION BY page, x, ink, iy) >= 4))::INT AS rule FROM islands)"""
_CLEAN = "clean AS (SELECT page, y, x, CASE WHEN rule > 0 AND sum(rule) OVER (PARTITION BY page) <= 0.80::DOUBLE * sum(ink) OVER (PARTITION BY page) THEN 0 ELSE ink END::INT AS ink FROM ruled)"


@query(_with("grid8", "mask8") + ", i AS (SELECT page, y, x, x - row_number() OVER (PARTITION BY page, y ORDER BY x) AS ix FROM mask8 WHERE ink > 0) SELECT page, y, min(x)::INT AS start, (max(x) + 1)::INT AS \"end\" FROM i GROUP BY page, y, ix")
def ink_runs(spark, sf_dir):
    return grid.runs(A.mask8(spark, sf_dir), "x", "y")


@query(_with("grid8", "mask8") + f", {_ISLANDS} SELECT page, y, x, ink, rule FROM ruled")
def rule_runs(spark, sf_dir):
    return grid.rules(A.mask8(spark, sf_dir), 4, 4)


@query(_with("grid8", "mask8") + f", {_ISLANDS}, {_CLEAN} SELECT page, y, x, ink FROM clean")
def rule_suppress(spark, sf_dir):
    return grid.suppress_rules(A.mask8(spark, sf_dir), 4, 4)


@query(_with("grid8", "mask8") + ", b AS (SELECT page, y // 2 AS line_no, (y // 2) * 2 AS r0, (y // 2) * 2 + 2 AS r1, min(x) AS x0, max(x) AS x1 FROM mask8 WHERE ink > 0 GROUP BY page, y // 2) SELECT page, line_no::INT AS line_no, greatest(0, x0 - 1)::INT AS x, greatest(0, r0 - 1)::INT AS y, (least(8, x1 + 1) - greatest(0, x0 - 1))::INT AS w, (least(8, r1 + 1) - greatest(0, r0 - 1))::INT AS h FROM b")
def line_bbox(spark, sf_dir):
    mask = A.mask8(spark, sf_dir)
    line = F.floor(F.col("y") / 2).cast("int")
    bands = mask.select("page", line.alias("line_no"), (line * 2).alias("r0"), (line * 2 + 2).alias("r1")).distinct()
    return grid.boxes(bands, mask)


@query("SELECT doc_id AS page, 0 AS line_no, greatest(0, 3 - (15 * h) // 100)::INT AS x, greatest(0, 2 - (20 * h) // 100)::INT AS y, (least(9 + h, 3 + h + (15 * h) // 100) - greatest(0, 3 - (15 * h) // 100))::INT AS w, (least(5 + h, 2 + h + (20 * h) // 100) - greatest(0, 2 - (20 * h) // 100))::INT AS h FROM (SELECT doc_id, (n_chars % 97 + 1)::INT AS h FROM documents)")
def pad_clamp(spark, sf_dir):
    h = (F.col("n_chars") % 97 + 1).cast("int")
    bands = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.lit(0).alias("line_no"), F.lit(2).alias("r0"), (h + 2).alias("r1"), F.lit(3).alias("x0"), (h + 3).alias("x1"), (h + 9).alias("pw"), (h + 5).alias("ph"))
    return grid.pad(bands, "floor")


@query(_with("grid8") + " SELECT page, y, x, round(g / 127.5 - 1, 6)::DOUBLE AS v FROM grid8")
def normalise_pm1(spark, sf_dir):
    return grid.normalise(A.grid8(spark, sf_dir)).withColumn("v", F.round("v", 6))


@query(_with("grid8", "mask8") + " SELECT page, sum(ink)::BIGINT AS ink, (sum(CASE WHEN ink > 0 THEN y * 8 + x + 1 ELSE 0 END) % 65521)::BIGINT AS checksum FROM mask8 GROUP BY page")
def mask_checksum(spark, sf_dir):
    return grid.checksum(A.mask8(spark, sf_dir), 8, 65521)


@query(_with("grid8") + " SELECT page, 0 AS line_no, (y - 1)::INT AS y, (x - 2)::INT AS x, g FROM grid8 WHERE y >= 1 AND y < 6 AND x >= 2 AND x < 7")
def crop(spark, sf_dir):
    px = A.grid8(spark, sf_dir)
    box = px.select("page").distinct().select("page", F.lit(0).alias("line_no"), F.lit(2).alias("x"), F.lit(1).alias("y"), F.lit(5).alias("w"), F.lit(5).alias("h"))
    return grid.crops(box, px)


# tiling

@query("SELECT doc_id, greatest(1, ceil(n_chars * 10 * 160 // 100 / 1024.0))::INT AS tiles, (n_chars * 10 * 160 // 100 <= 1024) AS fits FROM documents")
def tile_fit(spark, sf_dir):
    scaled = F.floor(F.col("n_chars") * 10 * 160 / 100)
    return A.table(spark, sf_dir, "documents").select("doc_id", metrics.tile_count(scaled).alias("tiles"), (scaled <= 1024).alias("fits"))


@query(_with("grid8") + " SELECT page, x, sum((g < 250)::INT)::BIGINT AS ink FROM grid8 GROUP BY page, x")
def column_ink(spark, sf_dir):
    return grid.column_ink(A.grid8(spark, sf_dir))


@query(_with("grid8") + ", c AS (SELECT page, x, sum((g < 128)::INT) AS ink FROM grid8 GROUP BY page, x) SELECT page, coalesce(max(x) FILTER (WHERE ink = 0), arg_min(x, struct_pack(ink := ink, x := x)))::INT AS cut FROM c WHERE x >= 2 AND x < 7 GROUP BY page")
def cut_column(spark, sf_dir):
    return grid.cut_column(grid.column_ink(A.grid8(spark, sf_dir), 128), 2, 7)


_TILES = """cols AS (SELECT page, x, sum((g < 128)::INT) AS ink FROM grid8 GROUP BY page, x),
cuts AS (
  SELECT page, -1 AS tile_no, 0 AS x0, 0 AS x1 FROM (SELECT DISTINCT page FROM cols)
  UNION ALL
  SELECT page, tile_no + 1, x1, CASE WHEN 8 - x1 <= 3 THEN 8 ELSE (
    SELECT coalesce(max(x) FILTER (WHERE ink = 0), arg_min(x, struct_pack(ink := ink, x := x))) FROM cols c WHERE c.page = k.page AND c.x >= k.x1 + 1 AND c.x < k.x1 + 3) END
  FROM cuts k WHERE x1 < 8)"""


@query(_with("grid8") + f", {_TILES} SELECT page, tile_no::INT AS tile_no, x0::INT AS x0, x1::INT AS x1 FROM cuts WHERE tile_no >= 0")
def tile_line(spark, sf_dir):
    from ..operators import tile

    return tile.partition(grid.column_ink(A.grid8(spark, sf_dir), 128), most=3, window=2)


@query("SELECT l_orderkey AS line, min(l_linenumber)::INT AS x, 0 AS y, (max(l_linenumber + l_quantity::INT) - min(l_linenumber))::INT AS w, max(l_suppkey % 50 + 1)::INT AS h FROM lineitem GROUP BY l_orderkey")
def tile_union_bbox(spark, sf_dir):
    t = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").cast("int").alias("x"), F.lit(0).alias("y"), F.col("l_quantity").cast("int").alias("w"), (F.col("l_suppkey") % 50 + 1).cast("int").alias("h"))
    return assemble.union_box(t, "line")


@query(_with("lines") + " SELECT page, string_agg(coalesce(text, ''), '' ORDER BY line_no) AS text FROM lines GROUP BY page")
def tile_text_join(spark, sf_dir):
    return assemble.line_text(A.lines(spark, sf_dir).withColumnRenamed("line_no", "tile_no"), "page")


# pages and metrics

@query(_with("lines") + " SELECT page, string_agg(coalesce(text, ''), chr(10) ORDER BY line_no) AS text FROM lines GROUP BY page")
def page_text(spark, sf_dir):
    return assemble.page_text(A.lines(spark, sf_dir), "page")


@query("SELECT doc_id AS page, line_no, text FROM (SELECT d.doc_id, coalesce(c.turn, 0) AS line_no, coalesce(c.text, d.text) AS text FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id)")
def no_line_fallback(spark, sf_dir):
    pages = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text")
    lines = A.lines(spark, sf_dir).join(pages.select("page"), "page", "left_semi")
    return assemble.with_fallback(pages, lines, "page", {"line_no": F.lit(0).cast("long")})


@query("SELECT doc_id AS page, (i - 1)::INT AS line_no, line AS text FROM (SELECT doc_id, unnest(string_split(text, '.')) AS line, generate_subscripts(string_split(text, '.'), 1) AS i FROM documents) WHERE trim(regexp_replace(line, '\\s+', ' ', 'g')) <> ''")
def drop_blank_lines(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", r"\.")).alias("line_no", "text"))
    return assemble.drop_blank(d)


@query(_with("pairs") + " SELECT item_id, levenshtein(pred, truth)::INT AS distance FROM pairs")
def edit_distance_ascii(spark, sf_dir):
    return A.pairs(spark, sf_dir).select("item_id", metrics.edit_distance(F.col("pred"), F.col("truth")).alias("distance"))


@query(_with("pairs") + " SELECT item_id, round((1 - levenshtein(pred, truth)::DOUBLE / greatest(length(pred), length(truth))) * 100, 6) AS accuracy FROM pairs")
def accuracy(spark, sf_dir):
    return A.pairs(spark, sf_dir).select("item_id", F.round(metrics.accuracy(F.col("pred"), F.col("truth")), 6).alias("accuracy"))


@query(_with("pairs") + " SELECT item_id, round((1 - levenshtein(pred, truth)::DOUBLE / greatest(length(pred), length(truth))) * 100, 2) AS accuracy FROM pairs")
def accuracy_rounded(spark, sf_dir):
    return A.pairs(spark, sf_dir).select("item_id", metrics.accuracy(F.col("pred"), F.col("truth"), DIALECTS["rust"]).alias("accuracy"))


@query(_with("pairs") + " SELECT item_id, round(levenshtein(pred, truth)::DOUBLE / length(truth), 6) AS cer FROM pairs")
def cer(spark, sf_dir):
    return A.pairs(spark, sf_dir).select("item_id", F.round(metrics.cer(F.col("pred"), F.col("truth")), 6).alias("cer"))


@query(_with("pairs") + ", r AS (SELECT greatest(1, ceil(length(truth) / 64.0))::INT AS tiles, levenshtein(pred, truth)::DOUBLE / length(truth) AS a, levenshtein(truth, pred)::DOUBLE / length(pred) AS b FROM pairs) SELECT tiles, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b FROM r GROUP BY tiles HAVING count(*) >= 3")
def ab_by_tiles(spark, sf_dir):
    p, t = F.col("pred"), F.col("truth")
    rows = A.pairs(spark, sf_dir).select(metrics.tile_count(F.length(t), 64).alias("tiles"), metrics.cer(p, t).alias("a"), metrics.cer(t, p).alias("b"))
    return assemble.ab_by_tiles(rows).withColumn("mean_a", F.round("mean_a", 6)).withColumn("mean_b", F.round("mean_b", 6))


@query("SELECT page_id, sha256(html) AS sha256 FROM pages")
def content_digest(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", metrics.digest(F.col("html").cast("binary")).alias("sha256"))


@query("SELECT conv_id::VARCHAR AS file, CASE WHEN role = 'user' THEN text END AS text, CASE WHEN role = 'user' THEN NULL ELSE 'not read' END AS error, role = 'user' AS success FROM conversations")
def batch_outcomes(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), "text", F.when(F.col("role") == "user", F.lit(None)).otherwise(F.lit("not read")).alias("error"))
    return assemble.outcomes(c)


@query("SELECT conv_id AS page, to_json(list(struct_pack(line_no := turn, text := text) ORDER BY turn))::VARCHAR AS report FROM conversations GROUP BY conv_id")
def json_report(spark, sf_dir):
    lines = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return A.lines(spark, sf_dir).groupBy("page").agg(F.to_json(lines, {"ignoreNullFields": "false"}).alias("report"))


@query("SELECT lower(regexp_extract(url, '\\.([A-Za-z]+)$', 1)) AS extension, count(*) AS n FROM pages WHERE lower(regexp_extract(url, '\\.([A-Za-z]+)$', 1)) IN ('html', 'com', 'net') GROUP BY 1")
def extension_filter(spark, sf_dir):
    from ..sources.files import extension

    e = extension(F.col("url"))
    return A.table(spark, sf_dir, "pages").select(e.alias("extension")).where(F.col("extension").isin("html", "com", "net")).groupBy("extension").agg(F.count("*").alias("n"))


@query(_with("lines") + " SELECT page, text, truth, CASE WHEN truth = '' OR text = '' THEN 0.0 ELSE round((1 - levenshtein(text, truth)::DOUBLE / greatest(length(text), length(truth))) * 100, 6) END::DOUBLE AS accuracy FROM (SELECT a.page, a.text, b.text AS truth FROM lines a JOIN lines b ON a.page = b.page AND a.line_no = 0 AND b.line_no = 1) WHERE strlen(text) = length(text) AND strlen(truth) = length(truth)")
def read_with_accuracy(spark, sf_dir):
    lines = A.lines(spark, sf_dir)
    read = lines.where("line_no = 0").select("page", "text")
    truth = lines.where("line_no = 1").select("page", F.col("text").alias("truth"))
    plain = lambda c: F.octet_length(c) == F.length(c)
    got = assemble.with_accuracy(read, truth, "page", DIALECTS["flat"]).where(F.col("truth").isNotNull() & plain("text") & plain("truth"))
    return got.withColumn("accuracy", F.round("accuracy", 6))


# text metrics over all texts; no twins, as DuckDB's distance counts bytes. The queries above keep to ASCII, for theirs.


def edit_distance_all(spark, sf_dir):
    return A.all_pairs(spark, sf_dir).select("item_id", metrics.edit_distance(F.col("pred"), F.col("truth")).alias("distance"))


def accuracy_all(spark, sf_dir):
    return A.all_pairs(spark, sf_dir).select("item_id", F.round(metrics.accuracy(F.col("pred"), F.col("truth")), 6).alias("accuracy"))


def accuracy_rounded_all(spark, sf_dir):
    return A.all_pairs(spark, sf_dir).select("item_id", metrics.accuracy(F.col("pred"), F.col("truth"), DIALECTS["rust"]).alias("accuracy"))


def cer_all(spark, sf_dir):
    return A.all_pairs(spark, sf_dir).select("item_id", F.round(metrics.cer(F.col("pred"), F.col("truth")), 6).alias("cer"))


def ab_by_tiles_all(spark, sf_dir):
    p, t = F.col("pred"), F.col("truth")
    rows = A.all_pairs(spark, sf_dir).select(metrics.tile_count(F.length(t), 64).alias("tiles"), metrics.cer(p, t).alias("a"), metrics.cer(t, p).alias("b"))
    return assemble.ab_by_tiles(rows).withColumn("mean_a", F.round("mean_a", 6)).withColumn("mean_b", F.round("mean_b", 6))


def read_with_accuracy_all(spark, sf_dir):
    lines = A.lines(spark, sf_dir)
    read = lines.where("line_no = 0").select("page", "text")
    truth = lines.where("line_no = 1").select("page", F.col("text").alias("truth"))
    return assemble.with_accuracy(read, truth, "page", DIALECTS["flat"]).where("truth is not null").withColumn("accuracy", F.round("accuracy", 6))


UNTWINNED = {f.__name__: f for f in (edit_distance_all, accuracy_all, accuracy_rounded_all, cer_all, ab_by_tiles_all, read_with_accuracy_all)}
