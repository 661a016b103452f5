"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a set of terms (lower-cased words) weighted by how often they occur. A term's sample has three
variables that depend on the term alone: r and c of a Gamma(2, 1) distribution and b uniform. With
t = floor(ln(weight) / r + b) the term's level is y = exp(r (t - b)) and its rank is a = c / (y exp(r)); the term
of least rank is the sample, and two weighted sets have the same sample with a probability that equals their
generalised Jaccard similarity, sum of minima over sum of maxima. SAMPLES independent draws are made, each over all
terms and all as columns of one aggregate; likeness is the share of equal samples.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, order

SAMPLES = 64
#: Draws of one aggregate: more of them in one generated method wouldn't be compiled to machine code.
BLOCK = 16
#: ln of the weight of a term that a text doesn't have: its rank is never the least.
ABSENT = -1e30


def _uniform(h: Column, shift: int, bits: int) -> Column:
    """In (0, 1): the given bits of a hash, in the middle of their cell."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)) / F.lit(float(1 << bits))


def rank(term: Column, log_weights: list[Column], i: Column) -> list[Column]:
    """ln a of a term (long) of each of the weights, in draw i."""
    x, y = F.xxhash64(i * 2, term), F.xxhash64(i * 2 + 1, term)
    r = -F.log(_uniform(x, 0, 20) * _uniform(x, 20, 20))
    c = -F.log(_uniform(y, 0, 30) * _uniform(y, 30, 30))
    b = _uniform(x, 40, 24)
    return [F.log(c) - r * (F.floor(w / r + b) - b + 1) for w in log_weights]


def samples(texts: DataFrame, keys: list[str], kinds: list[str], n: int = SAMPLES) -> DataFrame:
    """keys and a column of n samples for each of the kinds, columns with texts: 31-bit digests of the least ranks. A text without words has the empty term.

    What a draw has of a term is computed once for all kinds. Nothing is shuffled where texts is already partitioned by some of the keys.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("text")) for i, k in enumerate(kinds)])).alias("_x")
    words = texts.select(*keys, each).select(*keys, F.col("_x.kind").alias("_k"), (~F.col("_x.text").rlike(r"\S")).alias("_none"), F.explode(F.split(F.lower("_x.text"), r"\s+")).alias("_w")).where((F.col("_w") != "") | F.col("_none"))
    counts = [F.coalesce(F.log(F.sum((F.col("_k") == i).cast("long"))), F.lit(ABSENT)).alias(f"_l{i}") for i in range(len(kinds))]
    terms = words.groupBy(*keys, F.xxhash64("_w").alias("_t")).agg(*counts)
    size = min(BLOCK, n)
    blocks = terms.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(size))).alias("_b"))
    weights = [F.col(f"_l{i}") for i in range(len(kinds))]
    least = blocks.groupBy(*keys, "_b").agg(*[F.min(x).alias(f"_s{i}_{d}") for d in range(size) for i, x in enumerate(rank(F.col("_t"), weights, F.col("_b") + d))])
    digests = [F.array(*[F.xxhash64(f"_s{i}_{d}").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") for d in range(size)]).alias(k) for i, k in enumerate(kinds)]
    joined = least.select(*keys, "_b", *digests).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_b", *kinds))).alias("_s"))
    return joined.select(*keys, *[F.slice(F.flatten(F.col("_s")[k]), 1, n).alias(k) for k in kinds])


def likeness(a: Column, b: Column) -> Column:
    """Estimated generalised Jaccard similarity of two signatures."""
    return (F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)).cast("double")


def text_form(sig: Column) -> Column:
    """A signature as a string: eight hex digits a sample."""
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x.cast("long")), 8, "0"))), "")


def fingerprints(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) of every distinct (doc_id, text); null texts count as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text")).dropDuplicates(["rid"])
    return samples(rows, ["rid", "doc_id"], ["text"], n).select("doc_id", text_form(F.col("text")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text has its last third replaced by the beginning of the next document's in descending order of
    doc_id, the first one following the last. Null texts count as empty; an empty text has the empty term alone,
    so two empty texts have likeness 1 and an empty and another text 0. Rows equal in doc_id and text are one
    document; those of equal doc_id and different texts follow each other in the order of a hash, null doc_ids
    last. A single document is its own next. Other columns are ignored; an empty table gives no rows.

    The text is shuffled once, by a key of the row, and so are the beginnings of the next texts; counting terms,
    sampling and collecting samples reuse that partitioning.
    """
    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(doc_id, text).withColumn("rid", F.xxhash64("doc_id", "text"))
    ids = rows.groupBy("doc_id", "rid").agg(F.max(F.length("text").cast("long")).alias("n"))
    placed, many = order.positions(ids, F.col("doc_id").desc_nulls_last(), F.col("rid"))
    after = placed.select(F.pmod(F.col("position") - 1, F.lit(max(1, many))).alias("position"), F.col("rid").alias("next"))
    chain = common.materialise(placed.join(after, "position").select("rid", "doc_id", "next", F.floor(F.col("n") / 3).cast("int").alias("k")), "chain")
    # each use of the texts takes the same two columns, so that Spark shuffles them once; dropDuplicates would become an
    # aggregate with other ids in each use, and Spark would take the beginnings, which come after it, for different ones and shuffle them twice
    whole = rows.groupBy("rid").agg(F.first("text").alias("text"))
    heads = whole.select(F.col("rid").alias("next"), "text").join(chain.hint("merge"), "next").select("rid", "k", F.left("text", "k").alias("head"))
    both = whole.join(heads.hint("merge"), "rid").withColumn("edited", F.concat(F.left("text", F.length("text") - F.col("k")), "head"))
    signed = samples(both, ["rid"], ["text", "edited"], n).withColumnsRenamed({"text": "own"})
    facts = both.select("rid", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    # the short rows of the chain are shuffled to the samples here, so that these are shuffled for the last join only
    table = common.materialise(facts.join(signed, "rid").join(chain.select("rid", "doc_id", "next").hint("merge"), "rid"), "signed")
    common.drop_finished_shuffles(docs.sparkSession)
    nexts = table.join(table.select(F.col("rid").alias("next"), F.col("own").alias("other")), "next")
    return nexts.select("doc_id", "n_chars", "edited_sha256", text_form(F.col("own")).alias("fingerprint"), text_form(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("other")).alias("near_next"))
