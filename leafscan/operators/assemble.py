"""Lines to pages to documents, and outcomes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(number: str, text: str = "text", separator: str = "") -> Column:
    """Aggregate: texts in the order of a number; nulls are empty."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)


def line_text(tiles: DataFrame, *keys: str) -> DataFrame:
    """Tiles' texts put together without a separator."""
    return tiles.groupBy(*keys).agg(joined("tile_no").alias("text"))


def union_box(tiles: DataFrame, *keys: str) -> DataFrame:
    """The box around all tiles (x, y, w, h)."""
    right, low = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return tiles.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (low - F.min("y")).alias("h"))


def drop_blank(lines: DataFrame) -> DataFrame:
    return lines.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")


def page_text(lines: DataFrame, *keys: str, number: str = "line_no") -> DataFrame:
    """A page's lines joined by line feeds."""
    return lines.groupBy(*keys).agg(joined(number, separator="\n").alias("text"))


def with_fallback(pages: DataFrame, lines: DataFrame, key: str, whole: dict[str, Column]) -> DataFrame:
    """lines, and for each page without any a line made of the whole page."""
    none = pages.join(lines, key, "left_anti").select(*[whole.get(c, F.col(c)).alias(c) for c in lines.columns])
    return lines.unionByName(none)


def report(lines: DataFrame, path: str = "path", page: str = "page_no") -> DataFrame:
    """(path, success, pages): the nested report of a document, its pages and lines in order; blank lines stay out of `lines`."""
    line = F.struct(F.col("line_no").alias("n"), "text", "bbox")
    per = lines.groupBy(path, page).agg(F.array_sort(F.collect_list(line)).alias("l"))
    shown = F.transform(F.filter("l", lambda x: F.trim(x["text"]) != ""), lambda x: F.struct(x["text"].alias("text"), x["bbox"].alias("bbox")))
    per = per.select(path, F.struct(F.col(page).alias("page"), shown.alias("lines"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("full_text")).alias("p"))
    return per.groupBy(path).agg(F.lit(True).alias("success"), F.array_sort(F.collect_list("p"), lambda a, b: a["page"] - b["page"]).alias("pages"))


def outcomes(pages: DataFrame) -> DataFrame:
    """(file, text, error, success): errors are rows like any other."""
    return pages.select(F.col("path").alias("file"), F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error", F.col("error").isNull().alias("success"))


def with_accuracy(read: DataFrame, truth: DataFrame, key: str, dialect) -> DataFrame:
    """read joined to truth (key, truth) with `accuracy`; a page without a truth has none."""
    from ..functions.metrics import accuracy

    both = read.join(truth, key, "left")
    return both.withColumn("accuracy", F.when(F.col("truth").isNotNull(), accuracy(F.col("text"), F.col("truth"), dialect)))


def ab_by_tiles(rows: DataFrame, least: int = 3) -> DataFrame:
    """(tiles, n, mean_a, mean_b) of error rates a and b by tile count, for groups of the least size."""
    return rows.groupBy("tiles").agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b")).where(F.col("n") >= least)
