"""What the operators of this subpackage share: shared-folder tables, per-worker caches, components."""

import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its files, or its counted rows, are below this.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (unset: one machine, as in tests) one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="leafscan-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """df written as a table in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where, fs = _path(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafscan_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "_leafscan_path", None)
        if path:
            where, fs = _path(df.sparkSession, path)
            fs.delete(where, True)


def drop_finished_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of jobs that are over; it does so once their handles are collected."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, over all tasks that it runs."""
    return sys.__dict__.setdefault("_leafscan_cache", {}).setdefault(name, {})


def in_chunks(batches, columns, max_bytes=32 << 20):
    """Arrow batches as lists of Python columns, cut so that a piece holds about max_bytes of the last column, a text."""
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        n, size = batch.num_rows, batch.nbytes
        step = max(1, int(n * max_bytes / size)) if size > max_bytes else max(1, n)
        for at in range(0, n, step):
            yield [c.slice(at, step).to_pylist() for c in cols]


def _star_step(edges: DataFrame, large: bool) -> DataFrame:
    pairs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    if large:
        least = least.withColumn("least", F.least("u", "least"))
        return pairs.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
    linked = pairs.join(least, "u")
    return linked.select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (u, v: long); component is its least reachable node.

    Alternating large and small stars: every round is two grouped minima and joins, hot nodes are only
    ever split (partial minima, skew joins), and each round is written to the shared folder. Stops when a
    round changes nothing. No nodes: no rows.
    """
    table = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        now = table.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 20)))).first()
        if now == seen or now[0] == 0:
            break
        seen, old = now, table
        table = materialise(_star_step(_star_step(table, True), False), "edges")
        release(old)
    return table.select(F.col("u").alias("node"), F.col("v").alias("component")).union(table.select("v", "v").distinct())


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, n): how often each lower-cased word occurs in all of docs; words end at white space of ASCII, as in Python's bytes.split."""
    words = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), r"\s+")).alias("w")).where("w <> ''")
    return words.groupBy("w").agg(F.count("*").alias("n"))
