"""Pixel tables (page, y, x, g) and mask tables (page, y, x, ink) as DataFrame expressions, for grids small enough to explode."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def orient(px: DataFrame, tag: Column | int, width: int, height: int) -> DataFrame:
    """Upright pixels of grids of one stored size."""
    t = F.lit(tag) if isinstance(tag, int) else tag
    x, y, w, h = F.col("x"), F.col("y"), width - 1, height - 1
    nx = F.when(t == 2, w - x).when(t == 3, w - x).when(t == 5, y).when(t == 6, h - y).when(t == 7, h - y).when(t == 8, y).otherwise(x)
    ny = F.when(t == 3, h - y).when(t == 4, h - y).when(t == 5, x).when(t == 6, x).when(t == 7, w - x).when(t == 8, w - x).otherwise(y)
    return px.select("page", ny.cast("int").alias("y"), nx.cast("int").alias("x"), "g")


def corner_median(px: DataFrame, width: int, height: int) -> DataFrame:
    """(page, median) of the four corner patches; pixels in several patches count in each."""
    dx, dy = min(width, max(3, width // 10)), min(height, max(3, height // 10))
    left, right, top, bottom = F.col("x") < dx, F.col("x") >= width - dx, F.col("y") < dy, F.col("y") >= height - dy
    times = (left.cast("int") + right.cast("int")) * (top.cast("int") + bottom.cast("int"))
    return px.where(times > 0).groupBy("page").agg(F.percentile("g", F.lit(0.5), times.cast("long")).alias("median"))


def polarity(px: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels of light pages: those of dark ones are inverted."""
    m = corner_median(px, width, height)
    return px.join(m, "page").select("page", "y", "x", F.when(F.col("median") < 128, 255 - F.col("g")).otherwise(F.col("g")).cast("int").alias("g"))


def binarise(px: DataFrame, level: int = 128) -> DataFrame:
    return px.select("page", "y", "x", (F.col("g") < level).cast("int").alias("ink"))


def normalise(px: DataFrame) -> DataFrame:
    return px.select("page", "y", "x", (F.col("g") / 127.5 - 1).cast("double").alias("v"))


def runs(mask: DataFrame, along: str, across: str) -> DataFrame:
    """(page, across, start, end) of each unbroken run of ink along an axis."""
    place = F.col(along) - F.row_number().over(W.partitionBy("page", across).orderBy(along))
    return mask.where("ink > 0").withColumn("island", place).groupBy("page", across, "island").agg(F.min(along).alias("start"), (F.max(along) + 1).alias("end")).drop("island")


def rules(mask: DataFrame, least_x: int, least_y: int) -> DataFrame:
    """The mask with `rule`: whether a pixel lies in a run of the least length along either axis."""
    marked = mask.withColumn("_ix", F.col("x") - F.row_number().over(W.partitionBy("page", "y", "ink").orderBy("x")))
    marked = marked.withColumn("_iy", F.col("y") - F.row_number().over(W.partitionBy("page", "x", "ink").orderBy("y")))
    marked = marked.withColumn("_nx", F.count("*").over(W.partitionBy("page", "y", "ink", "_ix"))).withColumn("_ny", F.count("*").over(W.partitionBy("page", "x", "ink", "_iy")))
    rule = (F.col("ink") > 0) & ((F.col("_nx") >= least_x) | (F.col("_ny") >= least_y))
    return marked.select("page", "y", "x", "ink", rule.cast("int").alias("rule"))


def suppress_rules(mask: DataFrame, least_x: int, least_y: int, share: float = 0.80) -> DataFrame:
    """The mask without rules, page by page unless they are more than a share of its ink."""
    marked = rules(mask, least_x, least_y)
    total = marked.groupBy("page").agg(F.sum("ink").alias("_ink"), F.sum("rule").alias("_rule"))
    take = (F.col("_rule") > 0) & (F.col("_rule") <= share * F.col("_ink")) & (F.col("rule") > 0)
    return marked.join(total, "page").select("page", "y", "x", F.when(take, 0).otherwise(F.col("ink")).cast("int").alias("ink"))


def boxes(bands: DataFrame, mask: DataFrame, padding: str = "ceil") -> DataFrame:
    """(page, line_no, x, y, w, h) of bands (page, line_no, r0, r1), padded and kept inside the page; bands without ink go."""
    inked = bands.join(mask.where("ink > 0"), "page").where((F.col("y") >= F.col("r0")) & (F.col("y") < F.col("r1")))
    extent = inked.groupBy("page", "line_no", "r0", "r1").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    size = mask.groupBy("page").agg((F.max("x") + 1).alias("pw"), (F.max("y") + 1).alias("ph"))
    return pad(extent.join(size, "page"), padding)


def pad(extents: DataFrame, padding: str = "ceil") -> DataFrame:
    """Boxes of extents (page, line_no, r0, r1, x0, x1 inclusive, pw, ph)."""
    band = F.col("r1") - F.col("r0")
    if padding == "constant":
        dy = dx = F.lit(4)
    else:
        up = 99 if padding == "ceil" else 0
        dy, dx = F.floor((band * 20 + up) / 100), F.floor((band * 15 + up) / 100)
    x, y = F.greatest(F.lit(0), F.col("x0") - dx), F.greatest(F.lit(0), F.col("r0") - dy)
    w, h = F.least(F.col("pw"), F.col("x1") + dx) - x, F.least(F.col("ph"), F.col("r1") + dy) - y
    return extents.select("page", "line_no", *[v.cast("int").alias(n) for n, v in (("x", x), ("y", y), ("w", w), ("h", h))])


def crops(boxes_: DataFrame, px: DataFrame) -> DataFrame:
    """(page, line_no, y, x, g): the pixels of each box, counted from its corner."""
    p = px.select("page", F.col("y").alias("py"), F.col("x").alias("px"), "g")
    inside = (F.col("py") >= F.col("y")) & (F.col("py") < F.col("y") + F.col("h")) & (F.col("px") >= F.col("x")) & (F.col("px") < F.col("x") + F.col("w"))
    return boxes_.join(p, "page").where(inside).select("page", "line_no", (F.col("py") - F.col("y")).alias("y"), (F.col("px") - F.col("x")).alias("x"), "g")


def column_ink(px: DataFrame, level: int = 250) -> DataFrame:
    """(page, x, ink): pixels of each column that aren't paper."""
    return px.groupBy("page", "x").agg(F.sum((F.col("g") < level).cast("long")).alias("ink"))


def cut_column(columns: DataFrame, lo: Column | int, hi: Column | int) -> DataFrame:
    """(page, cut) in the search window [lo, hi): the last column without ink, else the first of least ink."""
    inside = columns.where((F.col("x") >= lo) & (F.col("x") < hi))
    white = F.max(F.when(F.col("ink") == 0, F.col("x")))
    return inside.groupBy("page").agg(F.coalesce(white, F.min_by("x", F.struct("ink", "x"))).cast("int").alias("cut"))


def checksum(mask: DataFrame, width: int, modulus: int) -> DataFrame:
    """(page, ink, checksum): pixels of ink, and the sum of their places from one by a modulus."""
    at = F.col("y") * width + F.col("x")
    return mask.groupBy("page").agg(F.sum("ink").cast("long").alias("ink"), (F.sum(F.when(F.col("ink") > 0, at + 1).otherwise(0)) % modulus).cast("long").alias("checksum"))
