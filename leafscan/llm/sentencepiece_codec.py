"""SentencePiece encoding of merge-type (BPE) vocabularies by a score-ordered agenda.

Adjacent symbol pairs that form a piece wait on a heap, best score first, leftmost among equals; merging a
pair makes its neighbours' pairs candidates. Symbols outside the vocabulary at the end fall back to bytes.
Merges never cross a boundary that no piece spans, so a text is cut there and each distinct cut is encoded
once a worker; every cut new to a batch is checked against the sentencepiece library in one call, whose
ids win (and are counted) should the two ever differ.
"""

import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
#: Encoded cuts kept by a worker, in each of two generations.
CACHE = 400_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    at = 0

    def varint(i):
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            n, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class MergeModel:
    """A merge-type vocabulary read from a model file; encode() gives the ids of a cut, without begin and end."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.ids, self.scores, self.bytes_, self.unk = {}, {}, {}, 0
        trainer, norm, at = {}, {}, 0
        for field, value in _fields(data):
            if field == 1:
                p = dict(_fields(value))
                piece, kind = p[1].decode(), p.get(3, 1)
                if kind == 6:
                    self.bytes_[int(piece[1:-1], 16)] = at
                elif kind == 2:
                    self.unk = at
                elif kind != 3:
                    self.ids[piece], self.scores[piece] = at, struct.unpack("<f", p.get(2, bytes(4)))[0]
                if kind in (4, 5):
                    raise ValueError("user-defined and unused pieces are not supported")
                at += 1
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                norm = dict(_fields(value))
        if trainer.get(3) != 2 or norm.get(1) != b"identity" or norm.get(4, 1) or len(self.bytes_) != 256:
            raise ValueError("only BPE models with byte fallback, identity normalisation and kept white space are supported")
        self.prefix = SPACE if norm.get(3, 1) else ""
        spanning = any(SPACE in p.strip(SPACE) or (p.strip(SPACE) and p.endswith(SPACE)) for p in self.ids)
        alone = not any("\n" in p for p in self.ids if len(p) > 1)
        line = "\n" if alone else ""
        self.cut = re.compile(r"(?s).+" if spanning else (r"\n|" * alone) + f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+").findall

    def normalise(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def encode(self, cut: str) -> list[int]:
        ids, scores = self.ids, self.scores
        if cut in ids and len(cut) == 1:
            return [ids[cut]]
        sym = list(cut)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            s = scores.get(sym[i] + sym[i + 1])
            if s is not None:
                agenda.append((-s, i, i + 1, len(sym[i]) + len(sym[i + 1])))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not sym[left] or not sym[right] or len(sym[left]) + len(sym[right]) != size:
                continue  # one of the two has been merged meanwhile
            sym[left] += sym[right]
            sym[right] = ""
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                s = scores.get(sym[left] + sym[nxt])
                if s is not None:
                    heapq.heappush(agenda, (-s, left, nxt, len(sym[left]) + len(sym[nxt])))
            prev = before[left]
            if prev >= 0:
                s = scores.get(sym[prev] + sym[left])
                if s is not None:
                    heapq.heappush(agenda, (-s, prev, left, len(sym[prev]) + len(sym[left])))
        out = []
        for s in sym:
            if s:
                i = ids.get(s)
                if i is None:
                    out.extend(self.bytes_[b] for b in s.encode("utf-8", "replace"))
                else:
                    out.append(i)
        return out


class Codec:
    """Batches of texts to ids and back; keeps what it has encoded and counts disagreements with the library."""

    def __init__(self, path: str):
        self.model, self.library = MergeModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
        self.new, self.old, self.mismatches = {}, {}, 0
        self.disagreed: set[str] = set()
        self.of_last: list[int] = []
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.library.bos_id(), self.library.eos_id()))

    def _learn(self, cuts: list[str]) -> None:
        if len(self.new) > CACHE:
            self.new, self.old = {}, self.new
        prefix = self.model.prefix
        ours = [self.model.encode(c) for c in cuts]
        # the library puts a space before a text: a cut that begins with one is given without it, any other behind a line end
        plain = [c.startswith(prefix) for c in cuts] if prefix else [True] * len(cuts)
        head = self.library.encode("\n")
        theirs = self.library.encode([(c[len(prefix):] if p else "\n" + c).replace(SPACE, " ") for c, p in zip(cuts, plain)], num_threads=1)
        for c, p, a, b in zip(cuts, plain, ours, theirs):
            if not p:
                b = b[len(head):] if b[: len(head)] == head else a
            elif c == prefix:
                b = a  # an empty text gets no prefix, so the library can't be asked
            if a != b:
                self.mismatches += 1
                self.disagreed.add(c)
            self.new[c] = np.array(b, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids with begin and end as little-endian 32-bit integers."""
        cuts = [self.model.cut(self.model.normalise(t)) for t in texts]
        new, old = self.new, self.old
        missing = set()
        for c in cuts:
            missing.update(c)
        missing = missing.difference(new)
        for c in [c for c in missing if c in old]:
            new[c] = old[c]
            missing.discard(c)
        known = new
        if missing:
            self._learn(list(missing))
            known = self.new if self.new is new else {**{k: new[k] for c in cuts for k in c if k in new}, **self.new}
        get = known.__getitem__
        self.of_last = [sum(map(self.disagreed.__contains__, c)) for c in cuts] if self.disagreed else [0] * len(cuts)
        return [self.begin + b"".join(map(get, c)) + self.end for c in cuts]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.library.decode([np.frombuffer(b, "<u4").tolist() for b in ids])


def _codec(path: str) -> Codec:
    cache = common.worker_cache("sentencepiece")
    if path not in cache:
        cache[path] = Codec(path)
    return cache[path]


def encode_decode(docs: DataFrame, model: str | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, ids array<int>, decoded) of every row; with digest, what op6 returns in their place.

    Whole texts, begin and end ids, no sampling. Null and empty texts are the begin and end ids alone and decode
    to an empty text. n_disagreed (with digest) counts a text's cuts that the agenda and the library encode differently; the
    library's ids are given for them. Repeated rows are kept, other columns ignored; an empty table gives no rows. model is a
    path that every executor can read.
    """
    path = model or default_model()

    def run(batches):
        codec = _codec(path)
        for doc_ids, texts in common.in_chunks(batches, ["doc_id", "text"], 8 << 20):
            ids = codec.encode([t or "" for t in texts])
            decoded = codec.decode(ids)
            first = pa.array(doc_ids, pa.int64())
            if digest:
                sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
                cols = [first, pa.array([len(b) // 4 for b in ids], pa.int64()), sha(ids), sha([t.encode("utf-8", "surrogatepass") for t in decoded]), pa.array(codec.of_last, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_disagreed"])
            else:
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids])]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([first, lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_disagreed long" if digest else "doc_id long, ids array<int>, decoded string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)
