"""LM scoring by masked pseudo-likelihood.

A window network predicts each word from two words on either side, never from itself: embeddings of the four words, one
table a place, are added, pass a tanh layer and give a softmax over word classes. A word's probability is its class's from the
network times its share of the class. Summed over all words this is the document's pseudo-log-likelihood.

Each of the VOCABULARY most frequent words has embeddings and a count of its own. All other words are known by their class
(length, and whether they are all letters), by one of 256 embeddings a class, and by a count of their own: counts of all words are hashed to CELLS cells
(words that share a cell have their mean count). So a word that occurs twice in the corpus is scored apart from one that
occurs once. The network is trained in numpy, from every word of every document: documents are dealt by a hash of their content into shards of bounded size,
in a fixed order, each shard's words are turned into numbers and learnt from in one pass, and the shards' weights are averaged by the words
that each learnt from. Scores don't depend on how the input is partitioned.
"""

from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY, CLASSES, HIDDEN, BATCH = 8192, 86, 16, 128
LARGE, EARLY = 2048, 256  # words of a batch after so many batches of BATCH
SHAPES = 10  # classes of words outside the vocabulary, by length and by whether they are all letters
OUTPUTS = CLASSES + SHAPES
BITS = 22
CELLS, BLOCK = 1 << BITS, 1 << 16
ROWS = VOCABULARY + SHAPES * 256  # embeddings; the last one more is the end of a text
PAD = ROWS
_TABLES, _OUT = 4 * (ROWS + 1) * HIDDEN, HIDDEN * OUTPUTS
#: Bytes of text in a shard, and what a row counts beside its bytes. Words outside the vocabulary that a task remembers.
SHARD, ROW_BYTES, REMEMBERED = 16 << 20, 64, 300_000


def _shape(w: str) -> int:
    return min(4, (len(w) - 1) // 3) * 2 + (not w.isalpha())


def _code(w: str) -> int:
    """The number of a word outside the vocabulary: its class and its cell."""
    s = _shape(w)
    return VOCABULARY + (s << BITS) + ((crc32(w.encode("utf-8", "replace")) + s * 40503) & (CELLS - 1))


class Vocabulary(dict):
    """Word, as UTF-8, to number."""

    room = REMEMBERED

    def __missing__(self, w):
        code = _code(w.decode("utf-8", "replace"))
        if self.room:
            self.room -= 1
            self[w] = code
        return code


class Model:
    """Words, and by number: rows of embeddings, classes, log shares of their class."""

    def __init__(self, words, cls, share, mass, cells):
        self.words, self.cls, self.share, self.mass, self.cells = words, cls, share, mass, cells
        self.bias = np.log((mass + 0.1) / (mass + 0.1).sum())

    def rows(self, ids):
        out = np.where(ids < VOCABULARY, ids, VOCABULARY + ((ids - VOCABULARY) >> BITS) * 256 + ((ids - VOCABULARY) & 255))
        out[ids < 0] = PAD
        return out

    def classes(self, ids):
        return np.where(ids < VOCABULARY, self.cls[np.minimum(ids, VOCABULARY - 1)], CLASSES + ((ids - VOCABULARY) >> BITS))

    def shares(self, ids):
        shape = np.maximum((ids - VOCABULARY) >> BITS, 0)
        rare = self.cells[(ids - VOCABULARY) & (CELLS - 1)].astype(np.float64) - np.log(np.maximum(self.mass[CELLS_OF[shape]], 1))
        return np.where(ids < VOCABULARY, self.share[np.minimum(ids, VOCABULARY - 1)], rare)


CELLS_OF = CLASSES + np.arange(SHAPES)


def vocabulary(docs: DataFrame) -> Model:
    """Counts of all words of all documents; what of them goes to the driver is bounded by VOCABULARY and CELLS."""
    counts = common.materialise(common.word_counts(docs), "words")
    top = counts.orderBy(F.desc("n"), "w").limit(VOCABULARY).toPandas()
    n = top["n"].to_numpy(float)
    last = (float(n[-1]), top["w"].iloc[-1]) if len(n) == VOCABULARY else (0.0, "")
    rare = counts.where((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("w") > last[1])))
    alpha = F.col("w").rlike(r"^\p{L}+$")
    shape = F.least(F.lit(4), F.floor((F.length("w") - 1) / 3)).cast("int") * 2 + F.when(alpha, 0).otherwise(1)
    cell = (F.crc32("w") + F.col("shape") * 40503).bitwiseAND(F.lit(CELLS - 1)).cast("int")
    # classes by equal shares of the square roots of counts, in the order of counts: frequent words have their own
    steps = np.cumsum(np.sqrt(n))
    cls = np.minimum((steps - np.sqrt(n)) / max(steps[-1] if len(steps) else 1, 1e-9) * CLASSES, CLASSES - 1).astype(np.int64)
    mass = np.bincount(cls, n, OUTPUTS) + 0.0
    share = np.log(n / mass[cls]) if len(n) else n
    rare = rare.withColumn("shape", shape)
    for r in rare.groupBy("shape").agg(F.sum("n").alias("n")).collect():
        mass[CLASSES + r["shape"]] = r.n
    found = rare.groupBy(cell.alias("cell")).agg(F.log(F.sum("n") / F.count("*")).cast("float").alias("l"))

    def pack(table):
        """A block of cells as two bytes a cell."""
        at, out = table["cell"].to_numpy(), np.zeros(BLOCK, np.float16)
        out[at % BLOCK] = table["l"].to_numpy()
        return pa.table({"block": pa.array([int(at[0]) // BLOCK], pa.int32()), "l": pa.array([out.tobytes()], pa.binary())})

    cells = np.zeros(CELLS, np.float16)
    for r in found.groupBy(F.floor(F.col("cell") / BLOCK).alias("b")).applyInArrow(pack, "block int, l binary").collect():
        cells[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.l, np.float16)
    common.release(counts)
    fill = VOCABULARY - len(n)
    return Model(list(top["w"]), np.r_[cls, np.zeros(fill, np.int64)], np.r_[share, np.zeros(fill)], mass, cells)


def _ids(texts, vocab) -> tuple[np.ndarray, np.ndarray]:
    """All words' numbers with two pads (-1) around each text, and each text's number of words. Words end at what Java's \\s takes for white space, as bytes.split does."""
    out, sizes = [[-1, -1]], []
    get = vocab.__getitem__
    for t in texts:
        ids = list(map(get, (t or "").lower().encode("utf-8", "replace").split()))
        sizes.append(len(ids))
        out.append(ids)
        out.append([-1, -1])
    return np.fromiter(chain.from_iterable(out), np.int32, 2 + sum(sizes) + 2 * len(sizes)), np.array(sizes, np.int64)


def _parts(w: np.ndarray):
    return w[:_TABLES].reshape(4, ROWS + 1, HIDDEN), w[_TABLES : _TABLES + _OUT].reshape(HIDDEN, OUTPUTS), w[_TABLES + _OUT :]


def start_weights(bias: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(17)
    return np.concatenate([rng.normal(0, 0.2, _TABLES), rng.normal(0, 0.1, _OUT), bias]).astype(np.float32)


def _around(rows, at):
    return [rows[at + o] for o in (-2, -1, 1, 2)]


def _hidden(tables, around):
    return np.tanh(tables[0][around[0]] + tables[1][around[1]] + tables[2][around[2]] + tables[3][around[3]])


def learn(w: np.ndarray, rows: np.ndarray, classes: np.ndarray, at: np.ndarray, state: list, rate: float = 0.1) -> None:
    """Adagrad steps on w, in place, over the words at the given places; an embedding is touched only where its word occurs."""
    tables, out, bias = _parts(w)
    if not state:
        state.extend([np.full((4, ROWS + 1), 1e-8, np.float32), np.full(out.shape, 1e-8, np.float32), np.full(bias.shape, 1e-8, np.float32), 0])
    seen, seen_out, seen_bias, _ = state
    seen, flat = seen.reshape(-1), tables.reshape(-1, HIDDEN)
    place, ones = (np.arange(4) * (ROWS + 1))[:, None], np.ones(OUTPUTS, np.float32)
    b = 0
    while b < len(at):
        p = at[b : b + (BATCH if state[3] < EARLY else LARGE)]
        b += len(p)
        around, target = _around(rows, p), classes[p]
        h = _hidden(tables, around)
        logits = h @ out
        logits += bias
        np.clip(logits, -60, 60, out=logits)
        np.exp(logits, out=logits)
        logits *= (np.float32(1 / len(p)) / (logits @ ones))[:, None]
        logits[np.arange(len(p)), target] -= np.float32(1 / len(p))
        dh = (logits @ out.T) * (1 - h * h)
        g = h.T @ logits
        seen_out += g * g
        out -= 0.5 * rate * g / np.sqrt(seen_out)
        g = logits.sum(0)
        seen_bias += g * g
        bias -= 0.5 * rate * g / np.sqrt(seen_bias)
        own = (np.array(around) + place).ravel()  # all four places at once
        order = np.argsort(own, kind="stable")
        own = own[order]
        edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        own, g = own[edge], np.add.reduceat(dh[order % len(p)], edge)
        seen[own] += np.einsum("ij,ij->i", g, g) / HIDDEN
        flat[own] -= g * (rate / np.sqrt(seen[own]))[:, None]
        state[3] += 1


def train(docs: DataFrame, model: Model) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, ids as int32 bytes) of every row, and the weights averaged over all shards."""
    first = start_weights(model.bias)
    shared = docs.sparkSession.sparkContext.broadcast((Model(model.words, model.cls, model.share, model.mass, None), first))
    many = max(1, -(-(docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(ROW_BYTES))).first()[0] or 0) // SHARD))

    def run(batches):
        model, first = shared.value
        vocab = Vocabulary(zip([w.encode() for w in model.words], range(len(model.words))))
        w, state, n = first.copy(), [], 0
        for doc_ids, texts in common.in_chunks(batches, ["doc_id", "text"], 8 << 20):
            ids, sizes = _ids(texts, vocab)
            at = np.flatnonzero(ids >= 0)
            n += len(at)
            learn(w, model.rows(ids), model.classes(ids), at, state)
            begin = np.cumsum(sizes + 2) - sizes
            own = [ids[b : b + k].tobytes() for b, k in zip(begin.tolist(), sizes.tolist())]
            nothing = pa.nulls(len(own), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(sizes), pa.array(own, pa.binary()), nothing], ["doc_id", "n", "ids", "w"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([n]), pa.nulls(1, pa.binary()), pa.array([w.tobytes()])], ["doc_id", "n", "ids", "w"])

    def add(table):
        table = table.sort_by("shard")
        total = sum(np.frombuffer(x, first.dtype if table["size"][0].as_py() == 4 else np.float64).astype(np.float64) * (k if table["size"][0].as_py() == 4 else 1) for k, x in zip(table["n"].to_pylist(), table["w"].to_pylist()))
        return pa.table({"shard": [table["shard"][0].as_py() // 16], "n": [sum(table["n"].to_pylist())], "size": pa.array([8], pa.int32()), "w": pa.array([total.tobytes()], pa.binary())})

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("h")).repartition(many, "h").sortWithinPartitions("h", "doc_id", "text")
    table = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, ids binary, w binary")
    table = common.materialise(table.withColumn("shard", F.spark_partition_id().cast("long")), "ids")
    sums, left = table.where("w is not null").select("shard", "n", F.lit(4).alias("size"), "w"), many
    while left > 1:  # a tree of sums, in a fixed order: no task and not the driver gets more than 16
        sums = sums.groupBy(F.floor(F.col("shard") / 16).alias("g")).applyInArrow(add, "shard long, n long, size int, w binary")
        left = -(-left // 16)
    got = sums.collect()
    if not got:
        return table, first
    (r,) = got
    return table.where("w is null").select("doc_id", "n", "ids"), (np.frombuffer(r.w) / r.n).astype(np.float32) if r.size == 8 else np.frombuffer(r.w, np.float32)


def score_ids(ids: np.ndarray, w: np.ndarray, model: Model) -> np.ndarray:
    """The log-probability of every number that isn't a pad, given its surroundings."""
    tables, out, bias = _parts(w)
    at = np.flatnonzero(ids >= 0)
    rows, classes = model.rows(ids), model.classes(ids)
    got = np.empty(len(at))
    for b in range(0, len(at), 2048):
        p = at[b : b + 2048]
        logits = _hidden(tables, _around(rows, p)) @ out
        logits += bias
        np.clip(logits, -60, 60, out=logits)
        own = logits[np.arange(len(p)), classes[p]].astype(np.float64)
        np.exp(logits, out=logits)
        got[b : b + 2048] = own - np.log(logits @ np.ones(OUTPUTS, np.float32))
    return got + model.shares(ids[at])


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, score) of every row: the summed conditional log-probabilities, and their mean.

    Null and empty texts have no word: both are 0. Repeated rows are kept (and learnt from), other columns
    ignored; rows equal in doc_id and text come to one shard. An empty table gives no rows.
    """
    model = vocabulary(docs)
    table, weights = train(docs, model)
    model.words = []
    shared = docs.sparkSession.sparkContext.broadcast((model, weights))  # CELLS counts and a fixed network

    def run(batches):
        model, weights = shared.value
        ends = np.full(2, -1, np.int32)
        for doc_ids, own in common.in_chunks(batches, ["doc_id", "ids"], 8 << 20):
            own = [np.frombuffer(x, np.int32) for x in own]
            sizes = np.array([len(x) for x in own], np.int64)
            ids = np.concatenate([ends, *chain.from_iterable((x, ends) for x in own)])
            last = np.cumsum(sizes)
            total = np.r_[0.0, np.cumsum(score_ids(ids, weights, model))]
            sums = total[last] - total[last - sizes]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(sizes), pa.array(sums), pa.array(sums / np.maximum(1, sizes))], ["doc_id", "n_tokens", "log_likelihood", "score"])

    return table.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, score double")
