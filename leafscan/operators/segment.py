"""Row profiles (page, y, ink; dense rows) to lines, as DataFrame expressions.

Windows are within a page, which has some thousands of rows; pages are spread over the cluster by their key, and
all steps after the profile keep that partitioning.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Dialect


def _rows():
    return W.partitionBy("page").orderBy("y")


def profile(mask: DataFrame) -> DataFrame:
    return mask.groupBy("page", "y").agg(F.sum("ink").cast("long").alias("ink"))


def smooth(rows: DataFrame, k: int, how: str) -> DataFrame:
    """rows with `s`: true_k takes k rows and divides by k, fixed 2 (k div 2) + 1 rows by k, visited by the rows there are."""
    if k <= 1:
        return rows.withColumn("s", F.col("ink").cast("double"))
    half = k // 2
    frame = _rows().rowsBetween(-half, (k - 1) // 2 if how == "true_k" else half)
    return rows.withColumn("s", F.avg("ink").over(frame) if how == "visited" else (F.sum("ink").over(frame) / k).cast("double"))


def threshold(smoothed: DataFrame, ratio: float = 0.05, of: str = "mean") -> DataFrame:
    """(page, t); null where a page has no ink."""
    value = F.max(F.when(F.col("s") > 0, F.col("s"))) if of == "max" else F.avg(F.when(F.col("s") > 0, F.col("s")))
    return smoothed.groupBy("page").agg((value * ratio).alias("t"))


def runs(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """(page, r0, r1): unbroken rows whose raw ink is over the page's limit; none without one."""
    over = rows.join(limits, "page").where("ink > t").withColumn("island", F.col("y") - F.row_number().over(_rows()))
    return over.groupBy("page", "island").agg(F.min("y").cast("int").alias("r0"), (F.max("y") + 1).cast("int").alias("r1")).drop("island")


def lists(runs_: DataFrame) -> DataFrame:
    """(page, runs): each page's runs from top to bottom."""
    return runs_.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("r0", "r1"))).alias("runs"))


def typical_height(runs_: Column, min_line: int = 10) -> Column:
    """Upper median of the heights of lines, or of all runs where none is a line; one at least."""
    heights = F.array_sort(F.transform(runs_, lambda r: r["r1"] - r["r0"]))
    tall = F.filter(heights, lambda h: h >= min_line)
    use = F.when(F.size(tall) > 0, tall).otherwise(heights)
    return F.greatest(F.lit(1), F.coalesce(F.get(use, F.floor(F.size(use) / 2).cast("int")), F.lit(1))).cast("int")


def merge(runs_: Column, inks: Column, typical: Column, max_gap: int = 10, min_line: int = 10) -> Column:
    """Runs folded from the top: see kernels.merge_runs. inks is the page's raw profile as an array."""
    kind = "array<struct<r0:int,r1:int>>"

    def step(done, r):
        last = F.element_at(done, -1)
        a0, a1 = last["r0"], last["r1"]
        gap = F.greatest(F.lit(0), r["r0"] - a1)
        bridged = (gap == 0) | ((F.size(F.slice(inks, a1 + 1, gap)) == gap) & F.forall(F.slice(inks, a1 + 1, gap), lambda v: v > 0))
        short, long_ = F.least(a1 - a0, r["r1"] - r["r0"]), F.greatest(a1 - a0, r["r1"] - r["r0"])
        fragment = (short * 2 <= typical) & (long_ >= min_line)
        joins = (gap <= max_gap) & (bridged | fragment) & (r["r1"] - a0 <= typical * 2)
        one = F.struct(a0.alias("r0"), r["r1"].alias("r1"))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(one))).otherwise(F.concat(done, F.array(F.struct(r["r0"].alias("r0"), r["r1"].alias("r1")))))

    start = F.slice(runs_, 1, 1).cast(kind)
    rest = F.slice(runs_, F.lit(2), F.greatest(F.lit(0), F.size(runs_) - 1))
    return F.when(F.size(runs_) == 0, F.array().cast(kind)).otherwise(F.aggregate(rest, start, lambda a, r: step(a, r).cast(kind)))


def merged(rows: DataFrame, runs_: DataFrame, max_gap: int = 10, min_line: int = 10) -> DataFrame:
    """(page, line_no, r0, r1): merged runs, numbered from the top; before the height filter."""
    dense = rows.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "ink"))), lambda v: v["ink"]).alias("inks"))
    pages = lists(runs_).join(dense, "page").withColumn("typical", typical_height(F.col("runs"), min_line))
    out = pages.select("page", F.posexplode(merge(F.col("runs"), F.col("inks"), F.col("typical"), max_gap, min_line)).alias("line_no", "r"))
    return out.select("page", "line_no", F.col("r.r0").alias("r0"), F.col("r.r1").alias("r1"))


def tall(bands: DataFrame, min_line: int = 10) -> DataFrame:
    """Bands of the least height, numbered anew."""
    number = F.row_number().over(W.partitionBy("page").orderBy("r0")) - 1
    return bands.where(F.col("r1") - F.col("r0") >= min_line).select("page", number.alias("line_no"), "r0", "r1")


def bands(rows: DataFrame, dialect: Dialect = Dialect()) -> DataFrame:
    """(page, line_no, r0, r1) of the lines of row profiles."""
    limits = threshold(smooth(rows, dialect.window, dialect.smooth), dialect.ratio, dialect.threshold)
    return tall(merged(rows, runs(rows, limits), dialect.max_gap, dialect.min_line), dialect.min_line)
