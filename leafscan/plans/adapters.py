"""Deterministic stand-ins for pages, made from the driver's tables; each has a twin in DuckDB's SQL (see TWINS)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8
CHARSET = "abcdefg"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid8(spark, sf_dir) -> DataFrame:
    """(page, y, x, g): an 8 x 8 grey page of each embedding."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page"), F.posexplode("embedding").alias("i", "v"))
    g = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), 128 + 255 * F.col("v").cast("double")))).cast("int")
    return e.select("page", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).cast("int").alias("x"), g.alias("g"))


def mask8(spark, sf_dir) -> DataFrame:
    from ..operators import grid

    return grid.binarise(grid8(spark, sf_dir))


def logits8(spark, sf_dir) -> DataFrame:
    """(vec_id, logits): eight steps of eight classes."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("logits"))


def profile(spark, sf_dir) -> DataFrame:
    """(page, y, ink): events of a type by hour since 2024, hours without any included."""
    hour = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600).cast("int")
    seen = table(spark, sf_dir, "events").where("event_type is not null and ts is not null").select(F.col("event_type").alias("page"), hour.alias("y")).where("y >= 0")
    counts = seen.groupBy("page", "y").agg(F.count("*").alias("ink"))
    dense = counts.groupBy("page").agg(F.max("y").alias("last")).select("page", F.explode(F.sequence(F.lit(0), "last")).alias("y"))
    return dense.join(counts, ["page", "y"], "left").select("page", "y", F.coalesce("ink", F.lit(0)).cast("long").alias("ink"))


def textgrid(spark, sf_dir) -> DataFrame:
    """(page, y, ink, width): a document's lines as rows, ink being characters that aren't spaces."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("y", "line"))
    return d.select("page", "y", F.length(F.replace("line", F.lit(" "), F.lit(""))).cast("long").alias("ink"), F.length("line").alias("width"))


def digitgrid(spark, sf_dir) -> DataFrame:
    """(page, y, ink): as textgrid, but only digits are ink, so that most pages are blank."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("y", "line"))
    return d.select("page", "y", F.length(F.regexp_replace("line", "[^0-9]", "")).cast("long").alias("ink"))


def lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("line_no"), "text")


def all_pairs(spark, sf_dir) -> DataFrame:
    """(item_id, pred, truth): a benchmark item and its neighbour."""
    b = table(spark, sf_dir, "benchmark")
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("truth"))
    return b.select("item_id", F.col("text").alias("pred")).join(after, "item_id")


def pairs(spark, sf_dir) -> DataFrame:
    """all_pairs where both are ASCII (DuckDB's distance counts bytes)."""
    plain = lambda c: F.octet_length(c) == F.length(c)
    return all_pairs(spark, sf_dir).where(plain("pred") & plain("truth"))



TWINS = {
    "grid8": """grid8 AS (SELECT vec_id AS page, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, floor(least(255.0, greatest(0.0, 128 + 255 * v::DOUBLE)))::INT AS g
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))""",
    "mask8": "mask8 AS (SELECT page, y, x, (g < 128)::INT AS ink FROM grid8)",
    "steps8": "steps8 AS (SELECT vec_id, ((i - 1) // 8)::INT AS t, ((i - 1) % 8)::INT AS c, v::DOUBLE AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))",
    "path8": "path8 AS (SELECT vec_id, t, arg_max(c, struct_pack(v := v, c := -c)) AS cls FROM steps8 GROUP BY vec_id, t)",
    "prof": """seen AS (SELECT event_type AS page, floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600)::INT AS y, count(*) AS ink FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND ts >= TIMESTAMP '2024-01-01' GROUP BY 1, 2),
dense AS (SELECT page, unnest(range(max(y) + 1))::INT AS y FROM seen GROUP BY page),
prof AS (SELECT d.page, d.y, coalesce(s.ink, 0)::BIGINT AS ink FROM dense d LEFT JOIN seen s ON d.page = s.page AND d.y = s.y)""",
    "digitgrid": "digitgrid AS (SELECT page, (i - 1)::INT AS y, length(regexp_replace(line, '[^0-9]', '', 'g'))::BIGINT AS ink FROM (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))",
    "textgrid": "textgrid AS (SELECT page, (i - 1)::INT AS y, length(replace(line, ' ', ''))::BIGINT AS ink, length(line)::INT AS width FROM (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))",
    "lines": "lines AS (SELECT conv_id AS page, turn AS line_no, text FROM conversations)",
    "pairs": "pairs AS (SELECT a.item_id, a.text AS pred, b.text AS truth FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 WHERE strlen(a.text) = length(a.text) AND strlen(b.text) = length(b.text))",
}
