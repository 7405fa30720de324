"""SimHash fingerprints and search by permuted block tables, in DataFrame operations only.

Each word of a text votes with its weight on every bit of its hash; a fingerprint has the bits with
more than half of the weight.  Two 32-bit counters share one 64-bit sum, so 128 bits take 64 sums
that Spark adds up as the words come out of the text, without a row a bit.

Search within a Hamming radius r: the fingerprint is cut into blocks, uneven ones if need be, and r is
shared out among them; within r differing bits one block at least differs in no more bits than its
share, so a table for each block, asked with that many bits flipped, finds every pair.  A pair counts
in the first table that has it.

Null texts count as empty; texts without words have an all-zero fingerprint.  Rows that repeat id and
text vote once and give one row.  Ties in votes give 0.  Null ids come first in the order of ids and
are ordered by hashes of their texts.  Counters hold texts of up to 4 GB.  An empty table gives an
empty result.  Only the id and the text are looked at, so other columns may have any name.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

BITS = 128
#: Bits within which near copies lie: of the pairs of different texts with 5-word Jaccard 0.75 or more, see README.
NEAR_COPY_RADIUS = 16
NO_ID = -(1 << 63)
LANES = 0x0000000100000001
#: Buckets of ids at most, and rows that one should have.
MAX_BUCKETS, BUCKET_ROWS = 4096, 250_000
#: Fingerprints of one key that one row carries, about, and ranges that null ids are dealt to.
MEMBERS, NULL_RANGES = 256, 4096
#: Characters between words, replaced by spaces.
BREAKS = "\n\r\t.,;:!?|\"()"


def word_weight(word: Column) -> Column:
    """Longer words say more; the weight is at most the length, so sums stay below the text's length."""
    n = F.char_length(word)
    return F.when(n <= 3, F.least(n, F.lit(1))).otherwise(n)


def add_votes(rows: DataFrame, text: Column, keys: list[str], keep: list[Column] = ()) -> DataFrame:
    """keys, keep and fingerprint halves fp0, fp1 of the text of each group of keys."""
    words = F.split(F.translate(F.lower(text), BREAKS, " " * len(BREAKS)), " ")
    exploded = rows.withColumn("__word", F.explode(words))
    weight, hashes = word_weight(F.col("__word")), [F.xxhash64("__word"), F.xxhash64("__word", F.lit(1))]
    exploded = exploded.withColumns({"__w": weight.cast("bigint"), "__h0": hashes[0], "__h1": hashes[1]})
    sums = [F.sum(F.col("__w") * F.shiftrightunsigned(f"__h{k}", i).bitwiseAND(F.lit(LANES))).alias(f"__s{k}_{i}") for k in range(2) for i in range(32)]
    votes = exploded.groupBy(*keys).agg(F.sum("__w").alias("__total"), *keep, *sums)

    def half(k: int) -> Column:
        bits = []
        for i in range(32):
            s = F.col(f"__s{k}_{i}")
            bits.append(F.shiftleft((s.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("__total")).cast("bigint"), i))
            bits.append(F.shiftleft((F.shiftrightunsigned(s, 32) * 2 > F.col("__total")).cast("bigint"), i + 32))
        return reduce(Column.bitwiseOR, bits)

    kept = [c for c in votes.columns if not c.startswith("__")]
    return votes.select(*kept, half(0).alias("fp0"), half(1).alias("fp1"))


def as_text(a: str, b: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(F.col(a)), 16, "0"), F.lpad(F.hex(F.col(b)), 16, "0")))


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1])))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return 1 - distance(a, b) / F.lit(float(BITS))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, __h (hash of the text), fp0, fp1; one row for each id and text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return add_votes(rows.withColumn("__hash", F.xxhash64("text")), F.col("text"), ["doc_id", "__hash"])


def _bucket(rows: DataFrame, key: str) -> Column:
    """Number of the quantile range that an id is in; ranges are in the order of ids."""
    total = rows.count()
    n = max(16, min(MAX_BUCKETS, 1 << max(0, (total // BUCKET_ROWS)).bit_length()))
    found = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 4 * n).alias("q")).first()["q"]
    cuts = F.array(*[F.lit(c).cast("bigint") for c in sorted(set(found or [0]))])
    steps = F.array(*[F.lit(n >> i) for i in range(1, n.bit_length())])
    place = F.aggregate(steps, F.lit(0), lambda p, s: p + F.when(F.get(cuts, p + s - 1) < F.col(key), s).otherwise(0))
    return place


def next_in_order(rows: DataFrame, key: str, tie: str, carry: list[str]) -> DataFrame:
    """rows (distinct key and tie, a number) with __next_<column> of the following row; the first follows the last.

    Rows are numbered in quantile ranges of the key, those of the missing id (NO_ID) in ranges of the
    tie; only the first row of each range, MAX_BUCKETS + NULL_RANGES at most, is looked at by one task.
    """
    names = [key, tie, *carry]
    known = rows.filter(F.col(key) != NO_ID)
    of_tie = F.shiftright(F.col(tie), 64 - (NULL_RANGES.bit_length() - 1)).cast("int") - NULL_RANGES // 2 - 1
    ranged = rows.withColumn("__b", F.when(F.col(key) == NO_ID, of_tie).otherwise(_bucket(known, key)))
    order = [F.col(key), F.col(tie)]
    inside = Window.partitionBy("__b").orderBy(*order)
    heads = ranged.groupBy("__b").agg(F.min(F.struct(*names)).alias("__head"))
    along = Window.orderBy("__b")
    whole = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("__b", F.coalesce(F.lead("__head").over(along), F.first("__head").over(whole)).alias("__after"))
    follow = ranged.withColumn("__lead", F.lead(F.struct(*names)).over(inside)).join(F.broadcast(after), "__b")
    pick = lambda c: F.when(F.col("__lead").isNotNull(), F.col(f"__lead.{c}")).otherwise(F.col(f"__after.{c}"))
    return follow.select(*names, *[pick(c).alias(f"__next_{c}") for c in names])


def with_edited(docs: DataFrame) -> DataFrame:
    """One row for each id and text: fingerprints of the text, of its edited text and of the next document.

    The edited text has its last half replaced by the beginning of the next document's text.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("did"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    narrow = stage_table(base.groupBy("did", "hash").agg(F.max(F.char_length("text").cast("bigint")).alias("n_chars")), "ids")
    follow = stage_table(next_in_order(narrow, "did", "hash", ["n_chars"]), "order")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    wanted = follow.select(F.col("did").alias("to_id"), F.col("hash").alias("to_hash"), half.alias("take"), F.col("__next_did").alias("did"), F.col("__next_hash").alias("hash"))
    sent = base.join(wanted, ["did", "hash"])
    heads = sent.select("to_id", "to_hash", F.substring(F.col("text"), F.lit(1), F.col("take")).alias("head")).groupBy(F.col("to_id").alias("did"), F.col("to_hash").alias("hash")).agg(F.max("head").alias("head"))
    # rows lie sorted by did and hash after the join: repeated rows become one without another exchange
    both = base.join(heads, ["did", "hash"]).groupBy("did", "hash").agg(F.first("text").alias("text"), F.first("head").alias("head"))
    size = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - F.floor(size / 2).cast("int")), F.col("head"))
    two = both.select("did", "hash", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), edited.alias("text")))).alias("t"))
    # the digest goes along as four numbers: a string would turn the hash aggregation into one that sorts every word
    sha = F.when(F.col("t.which") == 1, F.sha2(F.col("t.text"), 256))
    quarters = {f"sha{i}": F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10).cast("bigint") for i in range(4)}
    two = two.select("did", "hash", "t.which", "t.text", sha.alias("sha")).withColumns(quarters).drop("sha")
    # rows are dealt by did and hash already, so the votes aren't moved
    prints = add_votes(two, F.col("text"), ["did", "hash", "which"], [F.max(c).alias(c) for c in quarters])
    side = lambda w, c: F.max(F.when(F.col("which") == w, F.col(c)))
    per_doc = prints.groupBy("did", "hash").agg(side(0, "fp0").alias("fp0"), side(0, "fp1").alias("fp1"), side(1, "fp0").alias("ed0"), side(1, "fp1").alias("ed1"), *[side(1, c).alias(c) for c in quarters])
    per_doc = stage_table(per_doc, "votes")
    others = per_doc.select(F.col("did").alias("__next_did"), F.col("hash").alias("__next_hash"), F.col("fp0").alias("nx0"), F.col("fp1").alias("nx1"))
    full = per_doc.join(follow, ["did", "hash"]).join(others, ["__next_did", "__next_hash"])
    digest = F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in quarters]))
    return full.select(F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), "n_chars", digest.alias("edited_sha256"), "fp0", "fp1", "ed0", "ed1", "nx0", "nx1")


def block_plan(radius: int) -> list[tuple[int, int, int, int]]:
    """(half, shift, width, errors) of the blocks: within the radius, one of them has no more than its errors.

    Up to radius 3 there are four blocks, beyond it six of 21 or 22 bits; blocks don't cross the halves.
    """
    per = 2 if radius <= 3 else 3
    cuts = [64 * i // per for i in range(per + 1)]
    least, more = divmod(radius, 2 * per)
    blocks = [(t // per, cuts[t % per], cuts[t % per + 1] - cuts[t % per], least - (t > more)) for t in range(2 * per)]
    return [b for b in blocks if b[3] >= 0]


def block(half: int, shift: int, width: int, low: str, high: str) -> Column:
    return F.shiftrightunsigned(F.col(high if half else low), shift).bitwiseAND(F.lit((1 << width) - 1))


def _tables(corpus: DataFrame, plan: list) -> DataFrame:
    """Distinct fingerprints with the number of their rows, one row for each table: fp0, fp1, n, table, key."""
    return corpus.groupBy("fp0", "fp1").agg(F.count(F.lit(1)).alias("n")).select("fp0", "fp1", "n", F.posexplode(F.array(*_keys(plan, "fp0", "fp1"))).alias("table", "key"))


def _keys(plan: list, low: str, high: str) -> list[Column]:
    return [F.lit(t << 32).bitwiseOR(block(*b[:3], low, high)) for t, b in enumerate(plan)]


def _asked(queries: DataFrame, plan: list) -> DataFrame:
    """Distinct query fingerprints (q0, q1) with every key (q_key) under which a table may hold a near one.

    A key is asked with each set of flipped bits that the table's errors allow (masks, a number of rows
    fixed by the radius).
    """
    spark = queries.sparkSession
    flips = [(t, sum(1 << i for i in bits)) for t, (_, _, width, errors) in enumerate(plan) for k in range(errors + 1) for bits in combinations(range(width), k)]
    masks = spark.createDataFrame(flips, "q_table int, mask long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = queries.select(F.col("fp0").alias("q0"), F.col("fp1").alias("q1")).repartition(parts, "q0", "q1").distinct().crossJoin(F.broadcast(masks))
    return asked.select("q0", "q1", F.element_at(F.array(*_keys(plan, "q0", "q1")), F.col("q_table") + 1).bitwiseXOR(F.col("mask")).alias("q_key"))


def _new_pair(plan: list, table: Column, p: tuple[Column, Column], q: tuple[Column, Column]) -> Column:
    """No earlier table holds the pair: it counts in the first that does."""
    out = F.lit(True)
    for t, (half, shift, width, errors) in enumerate(plan[:-1]):
        differ = F.shiftrightunsigned(p[half].bitwiseXOR(q[half]), shift).bitwiseAND(F.lit((1 << width) - 1))
        out = out & ((table <= t) | (F.bit_count(differ) > errors))
    return out


def hamming_search(queries: DataFrame, corpus: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (q0, q1, fp0, fp1, n, distance) of distinct query and corpus fingerprints within the radius.

    corpus: fp0, fp1; n counts its rows with that fingerprint.  Equal fingerprints are merged first,
    so groups of copies cost one row.
    """
    plan = block_plan(radius)
    c, near = F.col, distance(("fp0", "fp1"), ("q0", "q1"))
    new = _new_pair(plan, c("table"), (c("fp0"), c("fp1")), (c("q0"), c("q1")))
    found = _asked(queries, plan).join(_tables(corpus, plan), (c("q_key") == c("key")) & (near <= radius) & new)
    return found.select("q0", "q1", "fp0", "fp1", "n", near.alias("distance"))


def near_counts(queries: DataFrame, corpus: DataFrame, radii: dict[str, int]) -> DataFrame:
    """q0, q1 and, by name, how many rows of the corpus lie within each radius; a query counts itself where the corpus has it.

    The tables are those of hamming_search for the largest radius.  The fingerprints of one key travel
    in rows of about MEMBERS and are compared inside the row, so a key that many share makes no row for
    each pair; a key with more of them is dealt to several rows by a hash.
    """
    plan = block_plan(max(radii.values()))
    stored = _tables(corpus, plan)
    many = stored.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > MEMBERS)
    parts = F.ceil(F.coalesce(F.col("size"), F.lit(1)) / MEMBERS)
    packed = stored.join(many, "key", "left").withColumn("part", F.pmod(F.xxhash64("fp0", "fp1"), parts)).groupBy("key", "part").agg(F.collect_list(F.struct("fp0", "fp1", "n")).alias("members"))
    met = _asked(queries, plan).join(packed, F.col("q_key") == F.col("key"))
    q, table = (F.col("q0"), F.col("q1")), F.shiftright("key", 32)
    away = lambda m: F.bit_count(m["fp0"].bitwiseXOR(q[0])) + F.bit_count(m["fp1"].bitwiseXOR(q[1]))
    within = F.filter("members", lambda m: (away(m) <= max(radii.values())) & _new_pair(plan, table, (m["fp0"], m["fp1"]), q))
    near = met.select("q0", "q1", F.transform(within, lambda m: F.struct(m["n"].alias("n"), away(m).alias("d"))).alias("near")).filter(F.size("near") > 0)
    count = lambda r: F.aggregate("near", F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["d"] <= r, x["n"]).otherwise(0))
    return near.groupBy("q0", "q1").agg(*[F.sum(count(r)).alias(name) for name, r in radii.items()])
