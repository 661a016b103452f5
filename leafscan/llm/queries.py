"""The registered queries of this subpackage: thin applications of its operators to whole tables."""

from pyspark.sql import functions as F

from . import decontaminate, line_dedup, lm_score, quality, sentencepiece_codec, simhash_neardup, suffix_dedup, toxicity, url_filter, weighted_fingerprint


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontaminate(spark, sf_dir):
    return decontaminate.find(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_lm_score(spark, sf_dir):
    return lm_score.score(_docs(spark, sf_dir))


def op3_toxicity(spark, sf_dir):
    return toxicity.score(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_weighted_fingerprint(spark, sf_dir):
    return weighted_fingerprint.edited_fingerprints(_docs(spark, sf_dir))


def op5_quality(spark, sf_dir):
    return quality.classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encode_decode(_docs(spark, sf_dir), digest=True)


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup(_docs(spark, sf_dir), digest=True)


def op8_url_filter(spark, sf_dir):
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def op9_line_dedup(spark, sf_dir):
    found = line_dedup.dedup_lines(_docs(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.col("_l_lines").alias("n_lines"), F.col("_l_removed").alias("n_removed"), F.col("_l_runs").alias("n_runs"), F.md5("_l_text").alias("kept_md5"))


def op10_simhash_neardup(spark, sf_dir):
    found = simhash_neardup.near_duplicates(_docs(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_lm_score, op3_toxicity, op4_weighted_fingerprint, op5_quality, op6_sentencepiece, op7_suffix_dedup, op8_url_filter, op9_line_dedup, op10_simhash_neardup)}

_LISTED = ", ".join(f"'{h}'" for h in url_filter.LISTED)

ORACLES = {
    "op9_line_dedup": line_dedup.ORACLE,
    "op8_url_filter": f"""
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
rules(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
listed(lhost) AS (SELECT unnest([{_LISTED}])),
fits AS (
  SELECT page_id, host, path, (SELECT max_by(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath))
    FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS hit,
    EXISTS (SELECT 1 FROM listed WHERE host = lhost OR ends_with(host, '.' || lhost)) AS bad
  FROM parsed)
SELECT page_id, host, path, hit.rule AS rule, CASE WHEN hit IS NOT NULL THEN hit.verdict WHEN bad THEN 'block' ELSE 'allow' END AS verdict FROM fits""",
}
