"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the vector of their bit counts moves by at most
one per flipped bit, so Manhattan distance between count vectors is a lower bound of Hamming distance. Counts
0, 1, 2 are held in unary (00, 01, 11), so that the whole vector is one long and the Manhattan distance is
the bit count of an exclusive or. The range join runs on grids: the 32 coordinates are dealt into radius + m
groups; two vectors within the radius agree wholly in m groups at least, so the grids over every choice of
m groups lose no pair, and a cell of each fixes a share m / (radius + m) of the coordinates. m grows with the number of
fingerprints, so that cells stay small. Pairs from a cell pass the Manhattan bound, then the exact Hamming distance.

Fingerprints within three bits are nearly equal texts only. Where links are asked for by similarity, links of this kind
are where the search starts; `near_copies` finds the rest and verifies all by exact similarity.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cells, common

SEGMENTS, RADIUS, SHINGLE, SEED = 32, 3, 3, 42

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()


def simhash_bytes(text: str | None, k: int = SHINGLE, seed: int = SEED) -> bytes:
    """The fingerprint, big-endian; no words: zero."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return bytes(8)
    digest = xxhash.xxh64_digest
    if len(words) <= k:
        return digest(b" ".join(words), seed)
    hashes = np.frombuffer(b"".join([digest(b" ".join(t), seed) for t in zip(*[words[i:] for i in range(k)])]), np.uint8).reshape(-1, 8)
    n = len(hashes)
    lanes = np.add.reduceat(_LANES[hashes], np.arange(0, n, 255), axis=0)  # a byte lane a bit: 255 hashes can't overflow it
    counts = lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n).tobytes()


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of every row; null texts count as empty."""

    def run(batches):
        for ids, texts in common.in_chunks(batches, ["doc_id", "text"]):
            fps = [int.from_bytes(simhash_bytes(t, k), "big", signed=True) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embed(fp):
    """Segment counts of a fingerprint column, in unary."""
    odd = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(odd), 1))


def grids(radius: int = RADIUS, m: int = 3) -> list[int]:
    """A mask for each choice of m of radius + m groups of coordinates."""
    parts = np.array_split(np.arange(SEGMENTS), radius + m)
    masks = [sum(3 << (2 * int(s)) for s in p) for p in parts]
    return [_signed(sum(c)) for c in combinations(masks, m)]


def groups_for(many: int) -> int:
    """m by the number of fingerprints. A coordinate agrees by chance with probability 3/8; so for radius 3 a node meets few others by chance: 0.6 at 2^22 fingerprints with m = 3, 0.8 at 2^28 with 5, 3 at 5e10 with 9 (20, 56 and 220 grids)."""
    return 3 if many <= 1 << 22 else 5 if many <= 1 << 28 else 9


def linked(reps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, component) over links of the radius or less between the nodes of reps (fp long, rep long; fp unique); see `cells`."""
    masks = grids(radius, groups_for(reps.count()))
    own = reps.select("fp", F.col("rep").alias("node"))
    at = own.select("node", F.explode(F.array(*[F.xxhash64(F.lit(i), embed(F.col("fp")).bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("s"))
    shared = at.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").select("s")
    table = common.materialise(at.join(shared, "s"), "cells")

    def verify(pairs):
        both = pairs.join(own.select(F.col("node").alias("u"), F.col("fp").alias("x")), "u").join(own.select(F.col("node").alias("v"), F.col("fp").alias("y")), "v")
        near = F.bit_count(embed(F.col("x")).bitwiseXOR(embed(F.col("y")))) <= radius
        return both.where(near & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius))

    return cells.components(table, verify)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long, component_id): component_id is the least doc_id reachable over links of the radius or less.

    Equal fingerprints are joined first, so copies never make pairs; a third of all rows with one fingerprint
    costs one grouped minimum. Null and empty texts have fingerprint zero and link like any other. Rows with a
    null doc_id take part under their fingerprint; where all its rows have a null doc_id they get a null
    component. Repeated rows are kept. Other columns of docs are ignored. An empty table gives no rows.
    """
    fps = common.materialise(fingerprints(docs, k), "fps")
    reps = common.materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    # one doc_id on rows of several texts: its fingerprints are one node
    same = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id").join(fps, "doc_id").join(reps.where("rep is not null"), "fp").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    near = linked(reps.where("rep is not null"), radius)
    if not same.isEmpty():
        near = common.connected_components(near.select(F.col("node").alias("u"), F.col("component").alias("v")).union(same))
    classes = reps.join(near, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")
