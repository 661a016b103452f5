"""Tiling of wide lines: each cut depends on the last, so a line's columns are folded by a higher-order function."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fits(width: Column, height: Column, target_height: int = 160, target_width: int = 1024) -> Column:
    """Whether a line fits the canvas; lines without area do."""
    return (width <= 0) | (height <= 0) | (F.floor(width * target_height / height) <= target_width)


def most_columns(width: Column, height: Column, target_height: int = 160, target_width: int = 1024) -> Column:
    return F.greatest(F.lit(1), F.floor(target_width / (F.lit(target_height) / height))).cast("int")


def partition(columns: DataFrame, most: int, window: int | None = None) -> DataFrame:
    """(page, tile_no, x0, x1) of lines given by the ink of their columns (page, x, ink; dense), in pieces of at most `most`.

    A cut is the last column without ink in the search window before x0 + most (12 % of most, or `window`), else the first of
    least ink. The fold visits as many steps as there could be tiles.
    """
    back = window if window is not None else max(1, int(most * 0.12))
    lists = columns.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "ink"))), lambda c: c["ink"]).alias("inks"))
    w = F.size("inks")

    def cut(x0):
        ideal = x0 + most
        lo = F.greatest(x0 + 1, ideal - back)
        spots = F.transform(F.slice("inks", lo + 1, F.greatest(F.lit(0), ideal - lo)), lambda v, i: F.struct((v > 0).alias("dark"), F.when(v > 0, v).otherwise(F.lit(0)).alias("ink"), F.when(v > 0, lo + i).otherwise(-(lo + i)).alias("at")))
        best = F.abs(F.array_min(spots)["at"])
        return F.when(w - x0 <= most, w).when(lo >= ideal, ideal).otherwise(F.greatest(x0 + 1, best)).cast("int")

    start = F.array(F.lit(0))
    step = lambda done, _: F.when(F.element_at(done, -1) < w, F.concat(done, F.array(cut(F.element_at(done, -1))))).otherwise(done)
    # a step moves on by most - back at least, or by one where that is none
    bound = F.ceil(w / max(1, most - back)).cast("int") + 1
    edges = F.aggregate(F.sequence(F.lit(1), bound), start, step)
    pieces = F.arrays_zip(F.slice(edges, F.lit(1), F.size(edges) - 1).alias("x0"), F.slice(edges, F.lit(2), F.size(edges) - 1).alias("x1"))
    return lists.select("page", F.posexplode(pieces).alias("tile_no", "t")).select("page", "tile_no", F.col("t.x0").alias("x0"), F.col("t.x1").alias("x1"))
