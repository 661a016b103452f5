"""Substring dedup over suffix arrays built by two-stage sorting.

A byte goes if a string of `length` bytes that covers it also starts in a document of smaller doc_id. The texts are
brought together in three steps:

1. Anchors. Every window of `length` bytes has an anchor: the leftmost k-gram of least hash in it. Equal windows have
   equal anchors at equal offsets, so anchors of one document alone can't be in a repeat. Documents are dealt into groups of
   bounded size; a group sends each k-gram hash once, however many of its documents hold it, and hears which are
   repeated elsewhere.
2. Strips. Around each repeated anchor lies a strip of text: the union of the windows that have this anchor. Of equal strips
   in a group only those of its least document go on; the others are covered whole by that one.
3. Suffix arrays. The distinct strips of the anchors that come to a bucket are joined into one string and its suffix array is
   built: only suffixes smaller than their successors are sorted directly, all others are induced by scanning the buckets of
   first bytes. Places whose common prefixes with their neighbours are `length` or longer hold one repeated string, and
   its least doc_id decides for all.

Strips with what is covered in them then go back to the documents. All is one job, in which the texts are shuffled once.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, GRAM = 50, 16
#: Bytes of text in a group of documents, about, and of strips in one suffix array (one anchor's strips stay together).
GROUP, ARRAY = 8 << 20, 1 << 20
#: Groups to a bucket of anchors, and to one of strips: messages go from every group to every bucket, so there are fewer of these.
TO_BUCKET, TO_ARRAYS = 16, 2
#: What a row counts beside its bytes, so that empty texts too are dealt into bounded groups.
ROW_BYTES = 64
#: Bytes that anchors are sought in at once: what fits a core's cache.
CHUNK = 256 << 10

_U = np.uint64


def _power(n):
    return _U(pow(0x9E3779B97F4A7C15, n, 1 << 64))


def gram_hashes(data: np.ndarray, k: int = GRAM) -> np.ndarray:
    """A mixed polynomial hash of every k-gram of bytes, by doubling."""
    with np.errstate(over="ignore"):
        part = {1: data.astype(_U) + _U(1)}
        n = 1
        while 2 * n <= k:
            p = part[n]
            part[2 * n] = p[:-n] * _power(n) + p[n:]
            n *= 2
        out, have = None, 0
        for n in sorted(part, reverse=True):
            if k & n:
                size = len(data) - k + 1
                piece = part[n][have : have + size]
                out = piece.copy() if out is None else out * _power(n) + piece
                have += n
        out ^= out >> _U(32)
        out *= _U(0xD6E8FEB86659FD93)
        out ^= out >> _U(29)
        out *= _U(0xD6E8FEB86659FD93)
        return out ^ (out >> _U(32))


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    n, have = x, 1
    while 2 * have <= w:
        n = f(n[:-have], n[have:])
        have *= 2
    return f(n[: len(n) - (w - have)], n[w - have :]) if w > have else n


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = GRAM):
    """Anchor places, their hashes, and their strips (from, to), of texts that lie apart in data.

    A window's anchor is the leftmost k-gram of least hash; only windows inside a text count.
    """
    w = length - k + 1
    long = ends - starts >= length
    starts, ends = starts[long], ends[long]
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none.astype(_U), none, none
    h = gram_hashes(data, k)
    least = _sliding(h, w, np.minimum)  # of the window that begins here
    inside = np.zeros(len(least) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends - length + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    # the window's anchor: the first place from its beginning whose hash is the least; equal neighbours share it
    low = least[at]
    spots = np.flatnonzero(_is_least(h, least, w))
    nxt = np.searchsorted(spots, at)
    anchor = spots[np.minimum(nxt, len(spots) - 1)]
    while True:
        wrong = np.flatnonzero(h[anchor] != low)
        if not len(wrong):
            break
        nxt[wrong] += 1
        anchor[wrong] = spots[nxt[wrong]]
    first = np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]
    b = np.flatnonzero(first)
    last = np.r_[b[1:], len(at)] - 1
    place = anchor[b]
    return place, h[place], at[b], at[last] + length


def _is_least(h, least, w):
    """Whether a k-gram has the least hash of any window that holds it."""
    fill = np.zeros(w - 1, _U)
    most = _sliding(np.r_[fill, least, fill], w, np.maximum)
    return h == most[: len(h)]


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of s (bytes) in the order of their first `depth` bytes at least, by two-stage sorting.

    Direct sorting is for suffixes smaller than their successors; the order of the rest is induced. Suffixes equal in
    `depth` bytes may be in any order.
    """
    n = len(s)
    if n < 2:
        return np.arange(n)
    # B: smaller than the successor; the last suffix, followed by the end, is larger than it
    diff = np.sign(s[1:].astype(np.int16) - s[:-1].astype(np.int16))
    change = np.flatnonzero(diff)
    nxt = np.searchsorted(change, np.arange(n - 1))
    up = np.r_[np.where(nxt < len(change), diff[change[np.minimum(nxt, len(change) - 1)]] if len(change) else -1, -1) > 0, False]
    direct = _sort_directly(s, np.flatnonzero(up), depth)
    counts = np.bincount(s, minlength=256)
    low = np.r_[0, np.cumsum(counts)]
    sa = np.empty(n, np.int64)
    front = low[:-1].copy()
    per = np.searchsorted(s[direct], np.arange(257))
    # the last suffix is the first of its bucket: nothing but the end follows it
    sa[front[s[n - 1]]] = n - 1
    front[s[n - 1]] += 1

    def induce(items, c):
        before = items[items > 0] - 1
        before = before[~up[before]]
        first = s[before]
        return before, first

    for c in range(256):
        if not counts[c]:
            continue
        at = low[c]
        while at < front[c]:  # suffixes of this bucket that were induced, also those induced while it is read
            items = sa[at : front[c]]
            at = front[c]
            _append(sa, front, *induce(items, c))
        mine = direct[per[c] : per[c + 1]]
        sa[low[c + 1] - len(mine) : low[c + 1]] = mine
        _append(sa, front, *induce(mine, c))
    return sa


def _append(sa, front, items, first):
    if not len(items):
        return
    order = np.argsort(first, kind="stable")
    items, first = items[order], first[order]
    edges = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
    for b, e in zip(edges, np.r_[edges[1:], len(items)]):
        c = first[b]
        sa[front[c] : front[c] + e - b] = items[b:e]
        front[c] += e - b


def _words(s: np.ndarray) -> np.ndarray:
    """The eight bytes from every place, big-endian, as numbers."""
    p = np.r_[s, np.zeros(64, np.uint8)]
    x = p.astype(_U)
    two = (x[:-1] << _U(8)) | x[1:]
    four = (two[:-2] << _U(16)) | two[2:]
    return (four[:-4] << _U(32)) | four[4:]


def _begins(new: np.ndarray) -> np.ndarray:
    """For each place the last place before or at it that begins a group."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _sort_directly(s, items, depth):
    """Eight bytes at a time; after each step only groups that are still equal go on."""
    if not len(items):
        return items
    words = _words(s)
    items = items[np.argsort(words[items], kind="stable")]
    key = words[items]
    group = _begins(np.r_[True, key[1:] != key[:-1]])
    for d in range(8, depth, 8):
        same = group[1:] == group[:-1]
        tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
        if not len(tied):
            break
        part, g = items[tied], group[tied]
        key = words[np.minimum(part + d, len(words) - 1)]
        order = np.lexsort((key, g))
        items[tied], key = part[order], key[order]
        group[tied] = tied[_begins(np.r_[True, (g[1:] != g[:-1]) | (key[1:] != key[:-1])])]
    return items


def repeats(s: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owners: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place of s (joined strips) the least owner of any strip that holds the string of `length` bytes from there.

    Two-stage suffix array over the joined strips, then adjacent common prefixes of `length` bytes or more. Places whose
    string would leave its strip have no meaning.
    """
    sa = suffix_array(s, length)
    ok = np.zeros(len(s) + 1, np.int32)
    np.add.at(ok, starts, 1)
    np.add.at(ok, starts + sizes - length + 1, -1)
    sa = sa[np.cumsum(ok)[sa] > 0]  # strings that lie in one strip
    words = _words(s)
    same = np.ones(len(sa) - 1, bool)
    for d in [*range(0, length - 7, 8), length - 8]:
        x = words[sa + d]
        same &= x[1:] == x[:-1]
    owner = owners[np.searchsorted(starts, sa, side="right") - 1]
    edge = np.flatnonzero(np.r_[True, ~same])
    out = np.full(len(s), np.iinfo(np.int64).max)
    out[sa] = np.repeat(np.minimum.reduceat(owner, edge), np.diff(np.r_[edge, len(sa)]))
    return out


def _joined(texts):
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    return np.frombuffer(b"".join(texts) + bytes(LENGTH + 64), np.uint8), starts, starts + sizes


def _all_anchors(texts, length):
    """(hashes, text numbers, from, to): the anchors of texts with their strips, places counted in each text.

    Runs over chunks; a long text is cut into pieces that overlap by a window less a byte, which may cut a strip in two but
    leaves every window in one strip of its anchor.
    """
    out, pieces, held = [], [], 0

    def flush():
        data, starts, ends = _joined([texts[i][a : a + CHUNK + length - 1] for i, a in pieces])
        place, h, lo, hi = anchors(data, starts, ends, length)
        at = np.searchsorted(starts, place, side="right") - 1 if len(place) else place
        number, offset = (np.array(x, np.int64) for x in zip(*pieces))
        shift = (offset - starts)[at]
        out.append((h, number[at], lo + shift, hi + shift))

    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), CHUNK):
            if len(t) - a >= length:
                pieces.append((i, a))
                held += min(CHUNK, len(t) - a)
                if held >= CHUNK:
                    flush()
                    pieces, held = [], 0
    if pieces:
        flush()
    if not out:
        return np.zeros(0, _U), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _split(buckets, *arrays):
    """(bucket, arrays of it as bytes) for each bucket there is."""
    order = np.argsort(buckets, kind="stable")
    found, edges = np.unique(buckets[order], return_index=True)
    for i, part in zip(found.tolist(), np.split(order, edges[1:])):
        yield i, [a[part].tobytes() for a in arrays]


def _coded(h: np.ndarray, buckets: int):
    """An anchor's bucket, and 31 further bits of its hash; anchors that these confuse are told apart by the suffix arrays."""
    return (h % _U(buckets)).astype(np.int64), ((h // _U(buckets)) & _U(0x7FFFFFFF)).astype(np.uint32)


def _numbers(row: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A number for each different (row, doc), the same in whatever order a group's rows come."""
    order = np.lexsort((doc, row))
    row, doc = row[order], doc[order]
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(np.r_[False, (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])]) if len(order) else 0
    return out


def _batch(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _merged(doc, lo, hi):
    """Intervals by document, overlapping and touching ones as one."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return doc, lo, hi
    base = np.cumsum(np.r_[0, doc[1:] != doc[:-1]]) << 40  # keeps documents apart in one running maximum
    top = np.maximum.accumulate(hi + base)
    new = np.r_[True, (lo + base)[1:] > top[:-1]]
    edge = np.flatnonzero(new)
    ends = np.maximum.reduceat(hi + base, edge) - base[edge]
    return doc[edge], lo[edge], ends


def spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(group, row, doc, text binary) of docs and (group, number, lo, hi as int32 bytes): what is to be removed of each row."""
    biggest = (1 << 63) - 1
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(ROW_BYTES))).first()[0] or 0
    many = max(1, -(-total // GROUP))
    buckets, heaps = -(-many // TO_BUCKET), -(-many // TO_ARRAYS)
    key = F.xxhash64("doc_id", "text")
    rows = docs.select(F.pmod(key, F.lit(many)).cast("int").alias("group"), F.coalesce(F.col("doc_id").cast("long"), F.lit(biggest)).alias("doc"), key.alias("row"), text.alias("text"))
    grouped = rows.repartition("group")

    def find_anchors(keys, table):
        """Each anchor once: the code, doubled, and whether two documents of the group have it."""
        h, at, _, _ = _all_anchors(table["text"].to_pylist(), length)
        doc = table["doc"].to_numpy()[at]
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else order
        low, high = doc[edge], doc[np.r_[edge[1:], len(h)] - 1] if len(h) else doc
        bucket, code = _coded(h[edge], buckets)
        sent = [(b, keys[0].as_py(), *x) for b, x in _split(bucket, (code << np.uint32(1)) | (low != high))]
        return pa.Table.from_batches([_batch(sent, ["bucket", "group", "h"], [pa.int32(), pa.int32(), pa.binary()])])

    found = grouped.groupBy("group").applyInArrow(find_anchors, "bucket int, group int, h binary")

    def resolve(keys, table):
        """Which anchors of a bucket two groups, or two documents of one, have; told to each group that has them."""
        parts = [np.frombuffer(x, np.uint32) for x in table["h"].to_pylist()]
        h = np.concatenate(parts)
        group = np.repeat(table["group"].to_numpy(), [len(p) for p in parts])
        order = np.argsort(h, kind="stable")
        h, group = h[order], group[order]
        code = h >> np.uint32(1)
        edge = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        size = np.diff(np.r_[edge, len(h)])
        again = np.repeat((size > 1) | np.logical_or.reduceat((h & np.uint32(1)) > 0, edge), size)
        told = [(g, keys[0].as_py(), *x) for g, x in _split(group[again].astype(np.int64), code[again])]
        return pa.Table.from_batches([_batch(told, ["group", "bucket", "h"], [pa.int32(), pa.int32(), pa.binary()])])

    told = found.groupBy("bucket").applyInArrow(resolve, "group int, bucket int, h binary")

    def cut_strips(left, right):
        """A group's strips around repeated anchors: those of the least document by bucket, the others as covered (without a text)."""
        texts, ids = left["text"].to_pylist(), left["doc"].to_numpy()
        names = _numbers(left["row"].to_numpy(), ids)
        known = [(b << 31) | np.frombuffer(x, np.uint32).astype(np.int64) for b, x in zip(right["bucket"].to_pylist(), right["h"].to_pylist())]
        h, at, lo, hi = _all_anchors(texts, length)
        bucket, code = _coded(h, buckets)
        keep = np.flatnonzero(np.isin((bucket << 31) | code, np.concatenate(known))) if known else np.zeros(0, np.int64)
        (bucket, code), at, lo, hi = _coded(h[keep], heaps), at[keep], lo[keep], hi[keep]
        cuts = [texts[i][a:b] for i, a, b in zip(at.tolist(), lo.tolist(), hi.tolist())]
        seen: dict[bytes, int] = {}
        of = np.array([seen.setdefault(t, len(seen)) for t in cuts], np.int64)
        doc = ids[at]
        least = np.full(len(seen), biggest)
        np.minimum.at(least, of, doc)
        own = doc == least[of]
        sent, covered = np.flatnonzero(own), np.flatnonzero(~own)
        group = left["group"][0].as_py() if left.num_rows else 0
        out = []
        size, begin, name = (hi - lo).astype(np.int32), lo.astype(np.int32), names[at]
        if len(covered):
            out.append((group % heaps, group, b"", name[covered].tobytes(), begin[covered].tobytes(), b"", size[covered].tobytes(), b""))
        for b, (bh, bn, bo, bd, bs, bi) in _split(bucket[sent], code[sent], name[sent], begin[sent], doc[sent], size[sent], sent):
            out.append((b, group, bh, bn, bo, bd, bs, pa.compress(b"".join([cuts[i] for i in np.frombuffer(bi, np.int64).tolist()]), codec="zstd", asbytes=True)))
        return pa.Table.from_batches([_batch(out, ["bucket", "group", "h", "number", "lo", "doc", "size", "text"], [pa.int32(), pa.int32(), *[pa.binary()] * 6])])

    strips = grouped.groupBy("group").cogroup(told.groupBy("group")).applyInArrow(cut_strips, "bucket int, group int, h binary, number binary, lo binary, doc binary, size binary, text binary")

    def match(table):
        """Suffix arrays over the strips of a bucket; what each strip's document loses."""
        read = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in table[c].to_pylist())])
        plain = pc.equal(pc.binary_length(table["doc"]), 0)
        covered, table = table.filter(plain), table.filter(pc.invert(plain))
        told = []
        for g, x, a, n in zip(*(covered[c].to_pylist() for c in ("group", "number", "lo", "size"))):
            told.append((g, x, a, (np.frombuffer(a, np.int32) + np.frombuffer(n, np.int32)).tobytes()))
        h, number, lo, doc, size = read("h", np.uint32), read("number", np.int32), read("lo", np.int32).astype(np.int64), read("doc", np.int64), read("size", np.int32).astype(np.int64)
        group = np.repeat(table["group"].to_numpy(), [len(x) // 4 for x in table["h"].to_pylist()]).astype(np.int64)
        whole = [int(np.frombuffer(x, np.int32).sum()) for x in table["size"].to_pylist()]
        data = np.frombuffer(b"".join([pa.decompress(x, n, "zstd", asbytes=True) for x, n in zip(table["text"].to_pylist(), whole)]), np.uint8)
        begin = np.cumsum(size) - size
        order = np.argsort(h, kind="stable")
        run = np.cumsum(size[order])
        out = [[], [], [], []]
        at = 0
        while at < len(order):
            stop = int(np.searchsorted(run, (run[at - 1] if at else 0) + ARRAY))
            stop = int(np.searchsorted(h[order], h[order][min(max(stop, at), len(order) - 1)], side="right"))
            part = order[at:stop]
            at = stop
            # equal strips are sorted once, under their least document
            seen: dict[bytes, int] = {}
            texts = [data[begin[i] : begin[i] + size[i]].tobytes() for i in part]
            of = np.array([seen.setdefault(t, len(seen)) for t in texts])
            owners = np.full(len(seen), biggest)
            np.minimum.at(owners, of, doc[part])
            sizes = np.array([len(t) for t in seen], np.int64)
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            least = repeats(np.frombuffer(b"".join(seen), np.uint8), starts, sizes, owners, length)
            # by strip: wholly covered where an equal strip has a smaller document, else where a string has one
            whole = np.flatnonzero(owners[of] < doc[part])
            out[0].append(group[part[whole]])
            out[1].append(number[part[whole]])
            out[2].append(lo[part[whole]])
            out[3].append((lo + size)[part[whole]])
            mine = np.flatnonzero(owners[of] == doc[part])
            inner = (sizes - length + 1)[of[mine]]
            spread = np.repeat(np.arange(len(mine)), inner)
            step = np.arange(len(spread)) - np.repeat(np.cumsum(inner) - inner, inner)
            bad = np.flatnonzero(least[starts[of[mine]][spread] + step] < doc[part[mine]][spread])
            if len(bad):
                # runs of neighbouring places become one interval
                s, t = spread[bad], step[bad]
                edge = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (t[1:] != t[:-1] + 1)])
                last = np.r_[edge[1:], len(s)] - 1
                who = part[mine[s[edge]]]
                out[0].append(group[who])
                out[1].append(number[who])
                out[2].append(lo[who] + t[edge])
                out[3].append(lo[who] + t[last] + length)
        g, r, a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        told += [(i, *x) for i, x in _split(g.astype(np.int64), r.astype(np.int32), a.astype(np.int32), b.astype(np.int32))]
        return pa.Table.from_batches([_batch(told, ["group", "number", "lo", "hi"], [pa.int32(), *[pa.binary()] * 3])])

    return grouped, strips.groupBy("bucket").applyInArrow(match, "group int, number binary, lo binary, hi binary")


def dedup(docs: DataFrame, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every row; with digest, kept_sha256 in place of kept.

    Texts are UTF-8 bytes, null is empty. Rows of one doc_id don't remove each other's bytes, and repeats inside a document
    don't count. Null doc_ids are larger than any number. Repeated rows are kept and get the same result. Other columns
    are ignored; an empty table gives no rows.
    """
    if length < GRAM + 8:
        raise ValueError("length must be GRAM + 8 or more")
    grouped, found = spans(docs, length)
    biggest = (1 << 63) - 1

    def cut(left, right):
        ids, names, texts = left["doc"].to_pylist(), _numbers(left["row"].to_numpy(), left["doc"].to_numpy()), left["text"].to_pylist()
        read = lambda c: np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int32) for x in right[c].to_pylist())])
        row, lo, hi = _merged(read("number"), read("lo"), read("hi"))
        a, b = np.searchsorted(row, names), np.searchsorted(row, names, side="right")
        out = []
        for i, t in enumerate(texts):
            los, his = lo[a[i] : b[i]].tolist(), hi[a[i] : b[i]].tolist()
            kept = b"".join(t[x:y] for x, y in zip([0, *his], [*los, len(t)]))
            out.append((None if ids[i] == biggest else ids[i], len(t), len(t) - len(kept), len(los), hashlib.sha256(kept).hexdigest() if digest else kept))
        last = ("kept_sha256", pa.string()) if digest else ("kept", pa.binary())
        return pa.Table.from_batches([_batch(out, ["doc_id", "n_bytes", "n_removed", "n_spans", last[0]], [*[pa.int64()] * 4, last[1]])])

    kind = "kept_sha256 string" if digest else "kept binary"
    return grouped.groupBy("group").cogroup(found.groupBy("group")).applyInArrow(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, {kind}")
