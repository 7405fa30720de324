"""Exact removal of repeated 100-byte strings by suffix sorting in buckets.

Every 100-byte window has an anchor: the places where the hash of its q-grams is smallest.  Equal
windows have equal anchors at equal places, so suffixes need to be compared only within the bucket of
their anchor's q-gram, and anchors are few (about one in 35 bytes).

1. Each task lists the anchors of its texts: the q-gram's bucket, and pointers to the buckets of the
   bytes before and after it as far as a window can reach.  Of equal ones in a batch the first goes on;
   the others repeat it.
2. The q-gram buckets are refined by sorting on the pointers of the other offsets.  Of anchors that
   stay in one bucket (three 64-bit identifiers) all but the first are repeats with all their windows.
   What is left to settle are q-gram buckets that fall apart, at the ends of repeated passages.
3. Their contexts are sorted on their bytes by bucket-pointer refinement: buckets by a first q-gram,
   refined by sorting on the pair of an offset's bucket and the bucket of the offset that follows it,
   each pass reusing the pointers that the last one updated (depths 4, 8, 16, 32, 64, 100).  Windows in
   one bucket at depth 100 are equal; the earliest stays.  Contexts are first dealt by the bytes next to
   the anchor on the side that a window must reach into.  Of a key with more than ``KEY_ROWS`` contexts
   the windows themselves are dealt out, each by a 128-bit hash of its place and bytes; those of q-grams
   with so many contexts, and more than one in ``HOT`` of all, never meet in one task.
4. Each text gets its repeated windows back and loses the bytes that they cover.

Order is by (doc_id, hash of the text, start); null ids come first.  Rows that repeat id and text are
one document: each is returned, none repeats the other.  A document with a null id is known by 126
bits of hashes of its text, one with an id by the id and 64 bits; ids below -2**62 are refused.  Null
texts count as empty; texts of less than 100 bytes stay whole; an empty table gives an empty result.
Long texts are taken in pieces of ``CHUNK`` bytes whose margins overlap, so memory doesn't grow with
them but for the text itself.  Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table
from .hashing import ODD, mix, sliding, window_hashes

SPAN, GRAM_BITS = 100, 5
GRAM = 1 << GRAM_BITS
SIDE = SPAN - GRAM  # bytes before and after the anchor's q-gram that a window can have
CONTEXT = SPAN + SIDE
HALF = SIDE // 2
#: Ids from here down stand for null ids.
NO_ID = -(1 << 62)
CHUNK = 1 << 19
#: Rows of a batch whose lists become Python objects at once.
SLICE_ROWS = 256
#: Contexts of one key that one task refines together, and of one refinement.
KEY_ROWS, REFINED = 20_000, 4000
#: Fewer q-grams than this have more than one in so many of the contexts.
HOT = 2000
PAD = bytes(CONTEXT)


def find_anchors(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, q-gram's bucket, pointers to the bytes before and after it) of every anchor."""
    sizes = np.array([len(r) for r in raw], np.int64)
    starts = np.cumsum(sizes + CONTEXT) - sizes  # every text stands between blank contexts
    data = np.frombuffer(PAD + b"".join(r + PAD for r in raw) + PAD, np.uint8)
    grams = window_hashes(data, GRAM_BITS)
    least = sliding(grams, SIDE + 1, np.minimum)  # over the q-grams of the window from each position
    inside = np.zeros(len(least) + 1, np.int32)
    windows = np.maximum(sizes - SPAN + 1, 0)
    np.add.at(inside, starts, windows > 0)
    np.add.at(inside, starts + windows, -(windows > 0).astype(np.int32))
    least[np.cumsum(inside[:-1]) == 0] = 0  # windows that leave their text
    most = sliding(np.concatenate([np.zeros(SIDE, np.uint64), least]), SIDE + 1, np.maximum)
    places = np.flatnonzero((most[: len(least)] == grams[: len(least)]) & (most[: len(least)] > 0))
    doc = np.searchsorted(starts, places, "right") - 1
    at = places - starts[doc]
    ok = (at >= 0) & (at + GRAM <= sizes[doc])
    places, doc, at = places[ok], doc[ok], at[ok]
    pointers = []
    for size, offsets in ((at, (-SIDE, -SIDE + GRAM, -GRAM)), (sizes[doc] - at - GRAM, (GRAM, 2 * GRAM, SPAN - GRAM))):
        pointer = np.minimum(size, SIDE).astype(np.uint64) * ODD[8]
        for k in offsets:
            pointer = mix(pointer * ODD[10] + grams[places + k])
        pointers.append(pointer)
    return doc, at, grams[places], *pointers


def pieces(sizes: list[int]):
    """Lists of (text number, first byte, last byte, start and end of the part whose anchors count) that fill about CHUNK."""
    out, total = [], 0
    for i, n in enumerate(sizes):
        for lo in range(0, max(n, 1), CHUNK):
            hi = min(lo + CHUNK, n)
            a, z = max(0, lo - CONTEXT), min(n, hi + CONTEXT)
            if out and total + z - a > CHUNK + 2 * CONTEXT:
                yield out
                out, total = [], 0
            out.append((i, a, z, lo, hi))
            total += z - a + CONTEXT
    if out:
        yield out


def sliced(batches):
    """The batches in slices of SLICE_ROWS rows, so that few of their texts and lists are held as objects."""
    for b in batches:
        for i in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(i, SLICE_ROWS)


def _order_batch(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """ids, text hashes and bytes of the distinct rows of a batch, in the order of documents."""
    ids, hashes = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
    order = np.lexsort((hashes, ids))
    ids, hashes = ids[order], hashes[order]
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
    return ids[keep], hashes[keep], b.column(2).take(pa.array(order[keep])).cast(pa.binary()).to_pylist()


CANDIDATE = "gram bigint, left bigint, right bigint, doc bigint, th bigint, pos int, repeats binary"
_CANDIDATE = pa.schema([("gram", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("repeats", pa.binary())])


def _list_anchors(batches):
    for b in batches:
        ids, hashes, raw = _order_batch(b)
        for part in pieces([len(r) for r in raw]):
            doc, at, gram, left, right = find_anchors([raw[i][a:z] for i, a, z, _, _ in part])
            number, shift, _, lo, hi = np.array(part, np.int64).T
            at = at + shift[doc]
            own = (at >= lo[doc]) & (at < hi[doc])
            doc, at, gram, left, right = number[doc[own]], at[own], gram[own], left[own], right[own]
            if not len(doc):
                continue
            order = np.lexsort((right, left, gram))  # stable: the first of equals stays the first
            g, x, y = gram[order], left[order], right[order]
            first = np.ones(len(order), bool)
            first[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            fresh = np.zeros(len(doc), bool)
            fresh[order[first]] = True
            d = doc[fresh]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[fresh].view(np.int64)) for c in (gram, left, right)], pa.array(ids[d]), pa.array(hashes[d]), pa.array(at[fresh].astype(np.int32)), pa.nulls(len(d), pa.binary())], schema=_CANDIDATE)
            d, p = doc[~fresh], at[~fresh].astype(np.int32)
            if len(d):  # places that repeat go along in one row a text, wherever the hash sends it
                cut = np.flatnonzero(np.diff(d, prepend=-1))
                rows = d[cut]
                packed = [p[a:z].tobytes() for a, z in zip(cut, [*cut[1:], len(d)], strict=True)]
                zero = pa.array(np.zeros(len(rows), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(mix(hashes[rows].view(np.uint64)).view(np.int64)), zero, zero, pa.array(ids[rows]), pa.array(hashes[rows]), pa.array(np.full(len(rows), -1, np.int32)), pa.array(packed, pa.binary())], schema=_CANDIDATE)


DECIDED = "doc bigint, th bigint, pos int, gram bigint, kind int, repeats binary"
_DECIDED = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("gram", pa.int64()), ("kind", pa.int32()), ("repeats", pa.binary())])
REPEAT, EDGE, PACKED = 1, 2, 3


def _judge_buckets(batches):
    """Rows sorted by gram, pointers and order of documents: which repeat an earlier one, which need a closer look."""
    held, held_edge = None, False  # first row of the last bucket seen, and whether it is known to be an edge

    def edges_of(gram, doc, th, pos):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(th), pa.array(pos), pa.array(gram), pa.array(np.full(len(doc), EDGE, np.int32)), pa.nulls(len(doc), pa.binary())], schema=_DECIDED)

    for b in batches:
        pos = b.column(5).to_numpy()
        packed = np.flatnonzero(pos < 0)
        if len(packed):
            t = b.take(pa.array(packed))
            yield pa.RecordBatch.from_arrays([t.column(3), t.column(4), t.column(5), t.column(0), pa.array(np.full(len(packed), PACKED, np.int32)), t.column(6)], schema=_DECIDED)
        plain = np.flatnonzero(pos >= 0)
        if not len(plain):
            continue
        columns = [b.column(k).to_numpy()[plain] for k in range(6)]
        if held is not None:
            columns = [np.concatenate([np.array([h], x.dtype), x]) for h, x in zip(held, columns, strict=True)]
        gram, left, right, doc, th, pos = columns
        n = len(gram)
        same_gram, same = np.zeros(n, bool), np.zeros(n, bool)
        same_gram[1:] = gram[1:] == gram[:-1]
        same[1:] = same_gram[1:] & (left[1:] == left[:-1]) & (right[1:] == right[:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        twin = same & (doc == doc[head]) & (th == th[head]) & (pos == pos[head])  # the same place, from a repeated row
        heads = np.flatnonzero(~same)
        edge = same_gram[heads].copy()
        edge[:-1] |= same_gram[heads[1:]]
        edge[0] |= held_edge
        held, held_edge = [c[heads[-1]] for c in columns], bool(edge[-1])
        repeat = np.flatnonzero(same & ~twin)
        if len(repeat):
            yield pa.RecordBatch.from_arrays([pa.array(doc[repeat]), pa.array(th[repeat]), pa.array(pos[repeat]), pa.array(gram[repeat]), pa.array(np.full(len(repeat), REPEAT, np.int32)), pa.nulls(len(repeat), pa.binary())], schema=_DECIDED)
        rows = heads[:-1][edge[:-1]]
        if len(rows):
            yield edges_of(gram[rows], doc[rows], th[rows], pos[rows])
    if held_edge:
        yield edges_of(*[np.array([held[k]], t) for k, t in ((0, np.int64), (3, np.int64), (4, np.int64), (5, np.int32))])


CONTEXTS = "key bigint, side int, doc bigint, th bigint, pos int, before int, after int, bytes binary"
_CONTEXTS = pa.schema([("key", pa.int64()), ("side", pa.int32()), ("doc", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("after", pa.int32()), ("bytes", pa.binary())])


def _cut_contexts(hot: frozenset, wanted: bool):
    """Contexts of the anchors that need a closer look, once for windows that reach far to the left and once to the right.

    Only those of hot q-grams are wanted, or only the others.
    """

    def run(batches):
        for b in sliced(batches):
            rows = [[] for _ in _CONTEXTS]
            seen = set()
            for did, th, raw, edges in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
                if (did, th) in seen:
                    continue
                seen.add((did, th))
                for e in edges:
                    pos, gram = e["pos"], e["gram"]
                    before, after = min(pos, SIDE), min(len(raw) - pos - GRAM, SIDE)
                    if before + after < SIDE or (gram in hot) != wanted:
                        continue
                    cut = bytes(SIDE - before) + raw[pos - before : pos + GRAM + after] + bytes(SIDE - after)
                    for side, near, reach in ((0, cut[SIDE - HALF : SIDE], before), (1, cut[SPAN : SPAN + HALF], after)):
                        if reach >= HALF:
                            key = int.from_bytes(hashlib.blake2b(near + gram.to_bytes(8, "little", signed=True) + bytes([side]), digest_size=8).digest(), "little", signed=True)
                            for column, value in zip(rows, (key, side, did, th, pos, before, after, cut), strict=True):
                                column.append(value)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _CONTEXTS, strict=True)], schema=_CONTEXTS)

    return run


def refine(data: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Bucket pointers at a depth of suffixes of the rows of data: equal where depth bytes are equal."""
    rows, width = data.shape
    first = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 4, axis=1)).view(np.uint32)[:, :, 0]
    pointers = np.unique(first, return_inverse=True)[1].reshape(rows, -1)
    have = 4
    while have < depth:
        step = min(have, depth - have)
        pair = pointers[:, : pointers.shape[1] - step].astype(np.int64) * (int(pointers.max()) + 1) + pointers[:, step:]
        pointers = np.unique(pair, return_inverse=True)[1].reshape(rows, -1)
        have += step
    return pointers


def real_windows(side: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """[rows, SIDE + 1]: is there a window from this place of the context, and does its side settle it?"""
    start = np.arange(SIDE + 1)
    back = SIDE - start  # bytes before the anchor
    real = (back <= before[:, None]) & (start <= after[:, None])
    return real & np.where(side[:, None] == 0, back >= HALF, back < HALF)


def repeated_windows(key: np.ndarray, real: np.ndarray, data: np.ndarray, same: np.ndarray) -> np.ndarray:
    """[rows, SIDE + 1]: is the window that starts at this place of the context an earlier row's, too?

    Rows are sorted by key and order of documents; same numbers the places that rows stand for.
    """
    pointers = refine(data)
    r, s = np.nonzero(real)
    group = np.cumsum(np.diff(key, prepend=key[:1] - 1) != 0)[r]
    code = (group * (SIDE + 1) + s) * (int(pointers.max()) + 1) + pointers[r, s]
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    out = np.zeros(real.shape, bool)
    out[r, s] = same[r[first]][inverse] != same[r]
    return out


SETTLED = "doc bigint, th bigint, lo int, hi int, w0 bigint, w1 bigint"
_SETTLED = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("w0", pa.int64()), ("w1", pa.int64())])


def _parts(t: pa.Table):
    side, doc, th, pos, before, after = (t.column(k).to_numpy() for k in range(1, 7))
    data = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint8).reshape(-1, CONTEXT)
    return doc, th, pos, real_windows(side, before, after), data


def _open_windows(t: pa.Table):
    """A row a window of some contexts."""
    for i in range(0, t.num_rows, REFINED):
        part = t.slice(i, REFINED)
        key, (doc, th, pos, real, data) = part.column(0).to_numpy(), _parts(part)
        r, s = np.nonzero(real)
        names = [hashlib.blake2b(data[x, y : y + SPAN].tobytes() + int(key[x]).to_bytes(8, "little", signed=True) + bytes([y]), digest_size=16).digest() for x, y in zip(r.tolist(), s.tolist(), strict=True)]
        w = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
        at = pa.array((s + pos[r] - SIDE).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(th[r]), at, at, pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy())], schema=_SETTLED)


def _hot_windows(hot: frozenset):
    """Texts with the edges of their contexts to the windows of hot q-grams."""
    cut = _cut_contexts(hot, True)

    def run(batches):
        for b in cut(batches):
            yield from _open_windows(pa.Table.from_batches([b]))

    return run


def _settle(key_rows: int):
    """Sorted contexts to ranges of window starts that repeat (w0 is null), and to the windows of keys with too many contexts."""

    def solve(t: pa.Table):
        key, (doc, th, pos, real, data) = t.column(0).to_numpy(), _parts(t)
        fresh = np.ones(len(key), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (pos[1:] != pos[:-1]) | (key[1:] != key[:-1])
        hit = repeated_windows(key, real, data, np.cumsum(fresh))
        step = np.diff(hit.astype(np.int8), axis=1, prepend=0, append=0)
        r, lo = np.nonzero(step == 1)
        _, hi = np.nonzero(step == -1)
        shift = pos[r] - SIDE
        none = pa.nulls(len(r), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(th[r]), pa.array((lo + shift).astype(np.int32)), pa.array((hi - 1 + shift).astype(np.int32)), none, none], schema=_SETTLED)

    def run(batches):
        rest, large = None, None  # rows of the last key, which may go on, and that key if it has too many
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            key = t.column(0).to_numpy()
            if large is not None:
                n = int(np.searchsorted(key, large, "right"))
                yield from _open_windows(t.slice(0, n))
                t, key = t.slice(n), key[n:]
                rest = None
                if not len(key):
                    continue
                large = None
            cut = int(np.searchsorted(key, key[-1]))
            rest = t.slice(cut)
            while cut:
                n = cut if cut <= REFINED else int(np.searchsorted(key[:cut], key[REFINED], "left")) or int(np.searchsorted(key[:cut], key[0], "right"))
                yield from _open_windows(t.slice(0, n)) if n > key_rows and key[0] == key[n - 1] else [solve(t.slice(0, n))]
                t, key, cut = t.slice(n), key[n:], cut - n
            if rest.num_rows > key_rows:
                large = key[-1]
                yield from _open_windows(rest)
                rest = None
        if rest is not None and rest.num_rows:
            yield solve(rest)

    return run


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def covered(size: int, anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Maximal [start, end) of the bytes covered by windows: all windows with the anchors given, and those that start from lo to hi."""
    lo = np.concatenate([np.maximum(anchors - SIDE, 0), lo])
    hi = np.concatenate([np.minimum(anchors, size - SPAN), hi])
    ok = lo <= hi
    order = np.argsort(lo[ok], kind="stable")
    lo, hi = lo[ok][order], np.maximum.accumulate(hi[ok][order] + SPAN) if ok.any() else hi[ok]
    first = np.ones(len(lo), bool)
    first[1:] = lo[1:] > hi[:-1]
    last = np.roll(first, -1)
    return np.stack([lo[first], hi[last]], 1)


def _spans_of(packed, repeats, windows, size: int) -> np.ndarray:
    anchors = np.concatenate([np.array(repeats or [], np.int64), *[np.frombuffer(x, np.int32).astype(np.int64) for x in packed or []]])
    lo, hi = np.array([w["lo"] for w in windows or []], np.int64), np.array([w["hi"] for w in windows or []], np.int64)
    return covered(size, anchors, lo, hi)


def _remove(keep_text: bool):
    def run(batches):
        for b in sliced(batches):
            ids, raws = b.column(0).to_pylist(), b.column(3).cast(pa.binary()).to_pylist()
            cols: list[list] = [[] for _ in range(5)]
            for did, raw, repeats, packed, windows in zip(ids, raws, b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True):
                spans = _spans_of(packed, repeats, windows, len(raw))
                kept, at = [], 0
                for lo, hi in spans.tolist():
                    kept.append(raw[at:lo])
                    at = hi
                kept = b"".join([*kept, raw[at:]])
                row = (None if did < NO_ID else did, len(raw), len(raw) - len(kept), len(spans), kept if keep_text else hashlib.sha256(kept).hexdigest())
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.binary() if keep_text else pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if keep_text else "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes kept (or the bytes, as kept)."""
    body = F.coalesce(F.col(text), F.lit(""))
    given = F.col(doc_id).cast("bigint")
    own = F.when(given.isNull(), F.shiftright(F.xxhash64(body, F.lit(1)), 2) - (1 << 61) * 3).when(given < NO_ID, F.raise_error(F.lit("ids below -2**62 are reserved")).cast("bigint")).otherwise(given)
    rows = docs.select(own.alias("did"), F.xxhash64(body).alias("th"), body.alias("body"))
    anchors = rows.mapInArrow(_list_anchors, CANDIDATE)
    judged = anchors.repartition("gram").sortWithinPartitions("gram", "left", "right", "doc", "th", "pos").mapInArrow(_judge_buckets, DECIDED)
    of = lambda kind, value: F.collect_list(F.when(F.col("kind") == kind, value))
    decided = stage_table(judged.groupBy("doc", "th").agg(of(REPEAT, F.col("pos")).alias("anchors"), of(PACKED, F.col("repeats")).alias("packed"), of(EDGE, F.struct("pos", "gram")).alias("edges")), "repeats")
    match = [F.col("did") == F.col("doc"), F.col("th") == F.col("d_th")]
    d = decided.withColumnRenamed("th", "d_th")
    # the same exchange of the texts serves both joins
    closer = rows.join(d.filter(F.size("edges") > 0).select("doc", "d_th", "edges"), match).select("did", "th", "body", "edges")
    counts = decided.select(F.explode("edges").alias("e")).groupBy("e.gram").agg(F.count(F.lit(1)).alias("n"))
    total = decided.agg(F.sum(F.size("edges"))).first()[0] or 0
    hot = frozenset(r["gram"] for r in counts.filter(F.col("n") > max(KEY_ROWS, total // HOT)).select("gram").collect())  # fewer than HOT
    contexts = closer.mapInArrow(_cut_contexts(hot, False), CONTEXTS).repartition("key").sortWithinPartitions("key", "doc", "th", "pos")
    settled = contexts.mapInArrow(_settle(KEY_ROWS), SETTLED)
    if hot:
        settled = settled.unionByName(closer.mapInArrow(_hot_windows(hot), SETTLED))
    settled = stage_table(settled, "settled")
    # windows of keys with too many contexts: all but the first of each are repeats
    loose = settled.filter(F.col("w0").isNotNull())
    firsts = loose.groupBy("w0", "w1").agg(F.min(F.struct("doc", "th", "lo")).alias("first"))
    again = loose.join(firsts, ["w0", "w1"]).filter(F.struct("doc", "th", "lo") != F.col("first"))
    windows = settled.filter(F.col("w0").isNull()).select("doc", "th", "lo", "hi").unionByName(again.select("doc", "th", "lo", "hi")).groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("windows"))
    w = windows.select(F.col("doc").alias("w_doc"), F.col("th").alias("w_th"), "windows")
    full = rows.join(d.select("doc", "d_th", "anchors", "packed"), match, "left").join(w, [F.col("did") == F.col("w_doc"), F.col("th") == F.col("w_th")], "left")
    return full.select("did", "th", F.lit(0), "body", "anchors", "packed", "windows").mapInArrow(_remove(keep_text), RESULT.replace("kept_sha256 string", "kept binary") if keep_text else RESULT)
