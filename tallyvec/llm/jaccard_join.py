"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes, and the groups that it links.

Sets of word shingles are ordered rare shingles first, by a bounded table of frequent shingles that
every task counts over all its rows and Spark sums up (any common order gives right results).  Two
sets with similarity t or more share at least l shingles in their prefixes of length
n - ceil(t n) + l.  Each document takes the l whose estimated cost - prefix entries, the documents met
there, and the candidates left after asking for l matches - is least, so documents made of frequent
shingles get longer prefixes and stricter matching.

1. One pass lists shingle counts and a digest of each set; equal sets are one class from here on.
2. A second pass lists the prefixes; shingles that one class alone has are dropped.
3. Every class is verified against its best partner among the first classes of its shingles; the
   links found give provisional groups.
4. Pairs of classes of *different* groups that share enough prefix shingles are verified, too; pairs
   inside a group can't change it.  Links of both kinds give the groups.  Enough means the matches
   that both ask for, and so many that the overlap needed is still in reach: beyond the prefix that
   ends first there are n - prefix shingles at most.

   Pairs meet at their shingles; for shingles of more than ``BUSY`` classes whole prefixes are
   compared in blocks instead, so a busy shingle gives no row for every pair.  A pair leaves the
   blocks at the first busy shingle only that both have.

No list of candidates is cut.  Sets travel only for pairs that are verified, and that the parity
sketches of their sets (an upper bound of the overlap) leave in reach.  Long texts are cut into
shingles in pieces of ``CHUNK`` bytes, so they take memory in proportion to their words only.  Columns
but the id and the text aren't looked at.  Shingles and sets are known by 64 and 128 bits of hashes.

Null texts and texts without words have empty sets and are linked with nothing; rows that repeat an
id are one document (of differing texts any linked one links the id); null ids are a document of their
own, smaller than all; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, chunks, drop_stage, release, stage_table
from .components import connected_components
from .hashing import ODD, mix, shingle_sets

NO_ID = -(1 << 63)
#: Texts handled in one vectorised step, in bytes, and rows of a batch: each byte takes some hundred bytes on the way.
CHUNK, ROWS = 256 << 10, 1000
#: Frequent shingles whose counts order the prefixes, of a task and of the corpus, and shingles that a task counts
#: at once: bounded hints, without effect on results.
HINTS, COUNTED = 1 << 16, 1 << 20
#: A class is dealt out by a broadcast table if more than one in HOT rows has it: fewer than HOT classes.
HOT = 2000
CHOICES = (1, 2, 3, 4, 6, 8, 12, 16)
#: Classes of a shingle up to which its pairs become rows; classes in one side of a block of pairs, and in one
#: side of a product; shingles in one product.
BUSY, BLOCK, STEP, SLAB = 8, 4096, 512, 2048
WHITE = b" \t\n\v\f\r"


def long_shingles(raw: bytes, size: int) -> np.ndarray:
    """Distinct shingle hashes of one text, in pieces of CHUNK bytes that share their last size - 1 words."""
    parts, rest, at = [], b"", 0
    while at < len(raw):
        end = at + CHUNK
        while end < len(raw) and raw[end] not in WHITE:  # no word is cut
            end += 1
        piece, at = rest + raw[at:end], end
        words = piece.rsplit(None, size - 1)
        if len(words) < size and at < len(raw):  # too few words for a shingle so far
            rest = piece + b" "
            continue
        parts.append(np.unique(shingle_sets([piece], size)[0]))
        rest = b" ".join(words[1:]) + b" "
        if not raw[at:].strip():
            break
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _sets(batches, size: int):
    """(ids, hashes, document numbers, bounds) chunk by chunk."""
    for b in batches:
        texts = b.column(1).cast(pa.binary()).to_pylist()
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for i, j in chunks(texts, CHUNK):
            raw = [t or b"" for t in texts[i:j]]
            if j - i == 1 and len(raw[0]) > 2 * CHUNK:
                h = long_shingles(raw[0], size)
                yield ids[i:j], h, np.zeros(len(h), np.int64), np.array([0, len(h)])
                continue
            h, d = shingle_sets(raw, size)
            yield ids[i:j], h, d, np.searchsorted(d, np.arange(len(raw) + 1))


class Frequent:
    """Counts of the more frequent of the hashes that a task sees: of COUNTED at once the rare ones are forgotten."""

    def __init__(self):
        self.keys, self.counts, self.fresh, self.waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.fresh.append(hashes)
        self.waiting += len(hashes)
        if self.waiting >= COUNTED:
            self._merge()

    def _merge(self) -> None:
        keys, counts = np.unique(np.concatenate([self.keys, *self.fresh]) if self.fresh else self.keys, return_counts=True)
        counts[np.searchsorted(keys, self.keys)] += self.counts - 1
        self.fresh, self.waiting, least = [], 0, 1
        while len(keys) > COUNTED // 2:  # the next count up is forgotten
            keys, counts = keys[counts > least], counts[counts > least]
            least += 1
        self.keys, self.counts = keys, counts

    def top(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        often = np.flatnonzero(self.counts > 1)
        if len(often) > HINTS:
            often = often[np.argpartition(-self.counts[often], HINTS)[:HINTS]]
        return self.keys[often], self.counts[often]


SUMMARY = "kind int, id bigint, n bigint, k0 bigint, k1 bigint, sketch binary"
_SUMMARY = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("k0", pa.int64()), ("k1", pa.int64()), ("sketch", pa.binary())])


def _digests(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two digests of every set."""
    n = np.diff(bounds)
    out = []
    for k in range(2):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h * ODD[4 + k]), out=sums[1:])
        out.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(np.uint64)).view(np.int64))
    return n, out[0], out[1]


def parity_sketch(h: np.ndarray) -> bytes:
    """Parities of the hashes by their low bits, two to four bits a hash.

    Two sets differ in as many hashes at least as their sketches, folded to one length, differ in bits.
    """
    bits = max(64, 1 << (2 * len(h)).bit_length())
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def most_overlap(x: bytes, y: bytes, nx: int, ny: int) -> int:
    """An upper bound of the hashes that sets of nx and ny hashes with these sketches share."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    least = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, least), axis=0) for v in (x, y))
    return min(nx, ny, (nx + ny - int(np.bitwise_count(x ^ y).sum())) // 2)


def _summarise(size: int):
    def run(batches):
        frequent = Frequent()
        for ids, h, _, bounds in _sets(batches, size):
            n, k0, k1 = _digests(h, bounds)
            m = len(ids)
            sketch = pa.array([parity_sketch(h[bounds[i] : bounds[i + 1]]) if n[i] else None for i in range(m)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array(ids), pa.array(n), pa.array(k0), pa.array(k1), sketch], schema=_SUMMARY)
            frequent.add(h)
        shingle, count = frequent.top()
        m = len(shingle)
        zero = pa.array(np.zeros(m, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(shingle.view(np.int64)), pa.array(count), zero, zero, pa.nulls(m, pa.binary())], schema=_SUMMARY)

    return run


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def choose_matches(n: int, counts: np.ndarray, percent: int) -> int:
    """The number of matches that a set of n shingles (document counts in prefix order) asks for."""
    need = least_overlap(n, percent)
    start = n - need
    costs = np.cumsum(np.maximum(counts - 1, 0))
    best, chosen = math.inf, 1
    for l in CHOICES:  # noqa: E741
        if l > need:
            break
        met = costs[start + l - 1]
        cost = (start + l) + met + met / (2 * l)  # entries, meetings, and candidates that are left
        if cost < best:
            best, chosen = cost, l
    return chosen


PREFIX = "shingle bigint, k0 bigint, k1 bigint, n int, need int"
_PREFIX = pa.schema([("shingle", pa.int64()), ("k0", pa.int64()), ("k1", pa.int64()), ("n", pa.int32()), ("need", pa.int32())])


def _prefixes(size: int, percent: int, hint_keys: np.ndarray, hint_counts: np.ndarray):
    def run(batches):
        for _, h, _, bounds in _sets(batches, size):
            n, k0, k1 = _digests(h, bounds)
            _, first = np.unique(k0.view(np.uint64) ^ mix(k1.view(np.uint64)), return_index=True)  # equal sets once a chunk
            place = np.searchsorted(hint_keys, h)
            place[place == len(hint_keys)] = 0
            count = np.where(hint_keys[place] == h, hint_counts[place], 1) if len(hint_keys) else np.ones(len(h), np.int64)
            taken, sizes, needs, rows = [], [], [], []
            for r in first.tolist():
                m = int(n[r])
                if not m:
                    continue
                a = int(bounds[r])
                own = count[a : a + m]
                if own.max() == 1:
                    l, order = 1, None  # noqa: E741
                else:
                    order = np.argsort(own, kind="stable")
                    l = choose_matches(m, own[order], percent)  # noqa: E741
                length = m - least_overlap(m, percent) + l
                taken.append(h[a : a + length] if order is None else h[a + order[:length]])
                sizes.append(length)
                needs.append(l)
                rows.append(r)
            if rows:
                rows = np.array(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(taken).view(np.int64)), pa.array(np.repeat(k0[rows], sizes)), pa.array(np.repeat(k1[rows], sizes)),
                    pa.array(np.repeat(n[rows], sizes).astype(np.int32)), pa.array(np.repeat(np.array(needs, np.int32), sizes)),
                ], schema=_PREFIX)

    return run


def _shared_only(batches):
    """Rows sorted by shingle and class, without repeats and without shingles of one class only."""
    held: pa.RecordBatch | None = None
    held_shared = False
    for b in batches:
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        s, k0, k1 = (b.column(i).to_numpy() for i in range(3))
        n = len(s)
        same = np.zeros(n + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        twin = np.zeros(n, bool)
        twin[1:] = same[1:-1] & (k0[1:] == k0[:-1]) & (k1[1:] == k1[:-1])
        keep = np.flatnonzero(~twin)
        sk = s[keep]
        before = np.zeros(len(keep), bool)
        before[1:] = sk[1:] == sk[:-1]
        before[0] = held_shared
        after = np.zeros(len(keep), bool)
        after[:-1] = before[1:]
        last = keep[-1]
        out = keep[:-1][(before | after)[:-1]]
        held, held_shared = b.slice(int(last), 1), bool(before[-1])
        if len(out):
            yield b.take(pa.array(out))
    if held is not None and held_shared:
        yield held


SETS = "id bigint, packed binary"


def _pack_sets(size: int, bits: np.ndarray):
    """Sets of the documents whose ids may be wanted."""

    def run(batches):
        mask = np.uint64(len(bits) - 1)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            b = b.take(pa.array(np.flatnonzero(bits[(mix(ids.view(np.uint64)) & mask).astype(np.int64)])))
            if b.num_rows:
                for own, h, _, bounds in _sets([b], size):
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([h[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(own))], pa.binary())], names=["id", "packed"])

    return run


def _verify(percent: int):
    def run(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good))

    return run


def _promising(percent: int):
    """Rows (a, b, an, bn, ask, bsk) to the pairs whose sketches leave the overlap needed in reach."""

    def run(batches):
        for b in batches:
            good = [100 * (o := most_overlap(x, y, nx, ny)) >= percent * (nx + ny - o) for nx, ny, x, y in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _verified(rows: DataFrame, sketches: DataFrame, pairs: DataFrame, size: int, percent: int, bloom_bits: int = 1 << 20) -> DataFrame:
    """The pairs (a, b) of ids whose sets are similar enough; sketches (id, n, sketch) spare sets the way."""
    spark = rows.sparkSession
    side = lambda x: sketches.select(F.col("id").alias(x), F.col("n").alias(f"{x}n"), F.col("sketch").alias(f"{x}sk"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "an", "bn", "ask", "bsk")
    with batch_rows(spark, 500):
        pairs = stage_table(both.mapInArrow(_promising(percent), PAIRS).distinct(), "pairs")
    release(spark)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def marks(batches):  # a bitmap of bounded size: it only saves work
        bits = np.zeros(bloom_bits, bool)
        for b in batches:
            bits[(mix(b.column(0).to_numpy().view(np.uint64)) & np.uint64(bloom_bits - 1)).astype(np.int64)] = True
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at)], names=["bit"])

    bits = np.zeros(bloom_bits, bool)
    found = wanted.mapInArrow(marks, "bit bigint").distinct().toPandas()["bit"].to_numpy(np.int64)  # bloom_bits numbers at most
    bits[found] = True
    sets = rows.mapInArrow(_pack_sets(size, bits), SETS)
    left = sets.select(F.col("id").alias("a"), F.col("packed").alias("pa"))
    right = sets.select(F.col("id").alias("b"), F.col("packed").alias("pb"))
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb")
    with batch_rows(spark, 500):  # two sets a row
        return stage_table(full.mapInArrow(_verify(percent), "a bigint, b bigint"), "verified")


def _overlap_needed(x, y, percent: int):
    return -(-percent * (x + y) // (100 + percent))


PAIRS = "a bigint, b bigint"


def _block_pairs(percent: int):
    """Sorted rows (shingle, lo, hi, block, rep, n, need, g, sign, prefix) to pairs that share enough of their prefixes.

    Odd hashes of a prefix stand for one busy shingle each: the pair leaves at the smallest that both have.
    """

    def compare(rep, n, need, g, sign, prefix, left, right):
        """Pairs of rows left x right; every prefix is an array of hashes."""
        rows = np.concatenate([left, right])
        sizes = [len(prefix[r]) for r in rows]
        signs, token, count = np.unique(np.concatenate([prefix[r] for r in rows]), return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(len(rows)), sizes)
        common = count[token] > 1
        names, token = np.unique(token[common], return_inverse=True)
        order = np.argsort(token, kind="stable")
        token, of = token[order], of[common][order]
        shared = np.zeros((len(left), len(right)), np.int64)
        first = np.flatnonzero((signs[names] & 1 == 1) & (signs[names] < sign)) if sign & 1 else names[:0]
        met = np.zeros(shared.shape, bool)
        for at in range(0, len(names), SLAB):
            width = min(SLAB, len(names) - at)
            i, j = np.searchsorted(token, [at, at + width])
            cells = np.bincount(of[i:j] * width + (token[i:j] - at), minlength=len(rows) * width)
            grid = cells.astype(np.float32).reshape(len(rows), width)  # hashes of a row that fall together count each: never too few
            shared += np.rint(grid[: len(left)] @ grid[len(left) :].T).astype(np.int64)
            before = first[(first >= at) & (first < at + width)] - at
            if len(before):
                met |= grid[: len(left), before] @ grid[len(left) :, before].T > 0.5
        x, y = left[:, None], right[None, :]
        nx, ny = n[x], n[y]
        beyond = np.maximum(-(-percent * nx // 100) - need[x], -(-percent * ny // 100) - need[y])
        least = np.maximum(np.minimum(need[x], need[y]), _overlap_needed(nx, ny, percent) - beyond)
        ok = ~met & (shared >= np.maximum(least, 1)) & (g[x] != g[y]) & (rep[x] != rep[y]) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))
        i, j = np.nonzero(ok)
        return rep[left[i]], rep[right[j]]

    def solve(t: pa.Table):
        rep, n, need, g = (t.column(k).to_numpy().astype(np.int64) for k in ("rep", "n", "need", "g"))
        block, lo, hi, sign = (t.column(k).to_numpy() for k in ("block", "lo", "hi", "sign"))
        prefix = [x.values.to_numpy() for x in t.column("prefix")]
        one, two = np.flatnonzero(block == lo[0]), np.flatnonzero(block == hi[0])
        for i in range(0, len(one), STEP):
            for j in range(i if lo[0] == hi[0] else 0, len(two), STEP):
                a, b = compare(rep, n, need, g, int(sign[0]), prefix, one[i : i + STEP], two[j : j + STEP])
                if len(a):
                    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            key = np.stack([t.column(k).to_numpy() for k in ("shingle", "lo", "hi")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            for a, z in zip([0, *cuts[:-1]], cuts, strict=True) if len(cuts) else ():
                yield from solve(t.slice(int(a), int(z - a)))
            rest = t.slice(int(cuts[-1])) if len(cuts) else t
        if rest is not None and rest.num_rows:
            yield from solve(rest)

    return run


def _busy_pairs(open_rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that meet at busy shingles; open_rows have m, the classes of their shingle, and head.

    Classes of different groups share open shingles only, so these are all that a prefix needs; they
    travel as 32-bit signs, which can make a pair a candidate but never hide one.
    """
    own = F.struct("shingle", "m", "sign")
    per = open_rows.groupBy("rep").agg(F.max("n").alias("n"), F.max("need").alias("need"), F.max("g").alias("g"), F.collect_list("sign").alias("prefix"), F.collect_list(F.when(F.col("head"), own)).alias("heads"))
    rows = per.select("rep", "n", "need", "g", "prefix", F.explode("heads").alias("h")).select("rep", "n", "need", "g", "prefix", "h.*")
    sides = F.ceil(F.col("m") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("rep"), F.col("sides")).cast("int")
    rows = rows.withColumn("sides", sides).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    rows = rows.select("shingle", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "n", "need", "g", "sign", "prefix")
    cells = rows.repartition("shingle", "lo", "hi").sortWithinPartitions("shingle", "lo", "hi")
    return cells.mapInArrow(_block_pairs(percent), PAIRS).distinct()


def _marked(mixed: DataFrame) -> DataFrame:
    """mixed (shingle, m, s0, s1, s2) with head and sign: 31 bits of a hash, and an odd one where it is that of one head alone.

    Busy shingles of the very same classes give the same pairs: the smallest of them, a head, stands for all.
    """
    half = F.shiftleft(F.hash("shingle"), 1)
    heads = mixed.filter(F.col("m") > BUSY).groupBy("m", "s0", "s1", "s2").agg(F.min("shingle").alias("shingle")).select("shingle", half.alias("half"))
    alone = heads.groupBy("half").agg(F.min("shingle").alias("shingle"), F.count(F.lit(1)).alias("heads"))
    odd = heads.join(alone.filter("heads = 1").select("shingle", F.lit(1).alias("odd")), "shingle", "left").select("shingle", F.lit(True).alias("head"), "odd")
    return mixed.join(odd, "shingle", "left").select("shingle", "m", F.coalesce("head", F.lit(False)).alias("head"), half.bitwiseOR(F.coalesce("odd", F.lit(0))).alias("sign"))


def _hints(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the most frequent shingles, HINTS at most, of what the tasks have counted.

    A histogram of the counts (16 steps each time that they double) tells which come to the driver.
    """
    sums = counted.groupBy("id").agg(F.sum("n").alias("c"))
    step = F.floor(F.log2("c") * 16).cast("int")
    taken, least = 0, None
    for r in sums.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():  # 1024 rows at most
        taken += r["n"]
        if taken > HINTS:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = sums.filter(step >= least).toPandas()
    order = np.argsort(found["id"].to_numpy(np.int64).view(np.uint64))
    return found["id"].to_numpy(np.int64).view(np.uint64)[order], found["c"].to_numpy(np.int64)[order]


def jaccard_groups(docs: DataFrame, size: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each id: n_shingles, component_id (smallest id reachable by links)."""
    with batch_rows(docs.sparkSession, ROWS):
        return _groups(docs, size, percent, doc_id, text)


def _groups(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    summary = stage_table(rows.mapInArrow(_summarise(size), SUMMARY), "summary")
    sets = summary.filter("kind = 0").select("id", "n", "k0", "k1")
    sketches = summary.filter("kind = 0 and n > 0").select("id", "n", "sketch")
    hint_keys, hint_counts = _hints(summary.filter("kind = 1"))
    prefixes = rows.mapInArrow(_prefixes(size, percent, hint_keys, hint_counts), PREFIX)
    shared = prefixes.repartition("shingle").sortWithinPartitions("shingle", "k0", "k1").mapInArrow(_shared_only, PREFIX)
    # a class goes by its smallest id from here on
    classes = sets.filter("n > 0").groupBy("k0", "k1", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    shared = stage_table(shared.join(classes.select("k0", "k1", "rep"), ["k0", "k1"]).select("shingle", "rep", "n", "need"), "shared")
    release(docs.sparkSession)

    # provisional groups: each class and its best partner among the first classes of its shingles
    def reach(x: str, y: str):
        """Shared prefix shingles without which the overlap needed can't be reached."""
        beyond = lambda n, need: F.ceil(F.col(n) * percent / 100) - F.col(need)  # noqa: E731  n minus the prefix's length
        return F.ceil((F.col(f"{x}_n") + F.col(f"{y}_n")) * percent / (100 + percent)) - F.greatest(beyond(f"{x}_n", f"{x}_need"), beyond(f"{y}_n", f"{y}_need"))

    firsts = shared.groupBy("shingle").agg(F.min(F.struct("rep", "n", "need")).alias("f")).select("shingle", F.col("f.rep").alias("a"), F.col("f.n").alias("a_n"), F.col("f.need").alias("a_need"))
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    stars = shared.withColumnsRenamed({"n": "b_n", "need": "b_need"}).join(firsts, "shingle").filter((F.col("a") < F.col("rep")) & fits(F.col("a_n"), F.col("b_n")))
    # a first class may stand for some of the shared shingles only: a third of what is needed is promising
    tried = stars.groupBy("a", "rep").agg(F.count(F.lit(1)).alias("c"), F.max(reach("a", "b")).alias("reach")).filter("3 * c >= reach")
    best = tried.groupBy("rep").agg(F.max(F.struct(F.col("c"), (-F.col("a")).alias("minus_a"))).alias("m"))
    found = _verified(rows, sketches, best.select((-F.col("m.minus_a")).alias("a"), F.col("rep").alias("b")), size, percent)
    groups = connected_components(found)
    release(docs.sparkSession)

    # pairs of different groups that share enough of their prefixes
    named = shared.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("g", F.coalesce("component", "rep")).select("shingle", "rep", "n", "need", "g")
    mark = F.xxhash64("rep", "n", "need")
    signs = [F.bit_xor(mark).alias("s0"), F.sum(F.shiftright(mark, 32)).alias("s1"), F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s2")]
    mixed = named.groupBy("shingle").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count(F.lit(1)).alias("m"), *signs)
    mixed = stage_table(mixed.filter("lo < hi").select("shingle", "m", *[F.when(F.col("m") > BUSY, F.col(c)).alias(c) for c in ("s0", "s1", "s2")]), "mixed")
    open_rows = stage_table(named.join(_marked(mixed), "shingle"), "open")
    drop_stage(shared)
    release(docs.sparkSession)
    busy = _busy_pairs(open_rows, percent)
    open_rows = open_rows.filter(F.col("m") <= BUSY)
    x = open_rows.select("shingle", *[F.col(c).alias(f"x_{c}") for c in ("rep", "n", "need", "g")])
    y = open_rows.select(F.col("shingle").alias("y_shingle"), *[F.col(c).alias(f"y_{c}") for c in ("rep", "n", "need", "g")])
    met = x.join(y, (F.col("shingle") == F.col("y_shingle")) & (F.col("x_rep") < F.col("y_rep")) & (F.col("x_g") != F.col("y_g")) & fits(F.col("x_n"), F.col("y_n")))
    enough = met.groupBy(F.col("x_rep").alias("a"), F.col("y_rep").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.max(F.greatest(F.least("x_need", "y_need").cast("bigint"), reach("x", "y"))).alias("least")).filter("c >= least")
    more = _verified(rows, sketches, enough.select("a", "b").unionByName(busy).distinct(), size, percent)
    for done in (open_rows, mixed):
        drop_stage(done)
    release(docs.sparkSession)

    final = connected_components(found.unionByName(more))
    of_class = stage_table(classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("k0", "k1", "n", "rows", F.coalesce("component", "rep").alias("component")), "classes")
    total = of_class.agg(F.sum("rows")).first()[0] or 0
    # classes with very many rows go along with the task, fewer than HOT of them
    hot = F.broadcast(of_class.filter(F.col("rows") * HOT > total).select("k0", "k1", "n", F.col("component").alias("hot")))
    marked = sets.join(hot, ["k0", "k1", "n"], "left")
    cold = marked.filter(F.col("hot").isNull()).join(of_class.filter(F.col("rows") * HOT <= total).drop("rows"), ["k0", "k1", "n"], "left")
    of_row = marked.filter(F.col("hot").isNotNull()).select("id", "n", F.col("hot").alias("component")).unionByName(cold.select("id", "n", "component"))
    out = of_row.groupBy("id").agg(F.max("n").alias("n"), F.min("component").alias("component"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("id").alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"), real("component").alias("__c"), F.col("component").isNull().alias("__alone"), "id").select("doc_id", "n_shingles", F.when(F.col("__alone"), F.col("doc_id")).otherwise(F.col("__c")).alias("component_id"))
