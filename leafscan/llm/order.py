"""A distributed total order: dense positions without a global window."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common


def positions(df: DataFrame, *order) -> tuple[DataFrame, int]:
    """df, written to the shared folder, with `position`: 0, 1, ... in the given order; and the number of rows.

    Rows are range-partitioned and sorted within partitions; only a count for each partition is brought into
    one place. Rows that the order ties are numbered in any order, once and for all.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    table = common.materialise(ranged, "order")
    part = F.shiftright("_at", 33)
    counts = table.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).select("_part", F.coalesce("_start", F.lit(0)).alias("_start"))
    out = table.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("position", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("_part", "_at", "_start"), table.count()
