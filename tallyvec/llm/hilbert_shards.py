"""Shards cut from a Hilbert-curve order of several metadata dimensions.

Each dimension is quantised at quantiles to ``bits`` bits, cells are numbered along the Hilbert
curve, rows are put in curve order and the order is cut into runs whose row counts differ by one at
most.  Written shards (``write_shards``) hold narrow ranges of every dimension, so a filter on any of
them leaves out whole files by their statistics.  Every step is a DataFrame operation.  Rows are ranked
without a global sort: a bucket is a curve cell and a hash of the row's id, bucket sizes are summed up
in curve order, and a window numbers the rows of each bucket; a cell with more than ``BUCKET_ROWS`` rows
has as many buckets as it needs.

Strings are quantised by the six bytes that follow the beginning that all of them share.  Null
dimensions count as smallest, null texts as empty; rows that repeat get ranks of their own, null ids
rank like an id; of rows that tie in id and text any order will do, since they are equal; an empty table
gives an empty result.  Names that begin with two underscores are reserved; a column named like a
result is replaced.  Long texts are only measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket, about: one task numbers them.
BUCKET_ROWS = 1 << 20
#: Cells of the curve at most: the tables made from them stay small.
MAX_CELLS = 4096


def hilbert_index(point: list[int], bits: int) -> int:
    """Place of a cell along the curve: axes are turned into the transposed index bit by bit."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, coarse to fine
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                swap = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = 0
    for b in range(bits - 1, 0, -1):
        if x[-1] >> b & 1:
            turn ^= (1 << b) - 1
    index = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | ((v ^ turn) >> b & 1)
    return index


def curve_table(dims: int, bits: int) -> list[int]:
    """Hilbert index of each cell, cells counted with the first dimension as the highest digit."""
    if 1 << (dims * bits) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    side = (1 << bits) - 1
    return [hilbert_index([cell >> bits * (dims - 1 - d) & side for d in range(dims)], bits) for cell in range(1 << dims * bits)]


def order_key(value: Column, kind: str, shared: int = 0) -> Column:
    """A number that sorts as the value does: strings by the six bytes after those that all share."""
    if kind == "string":
        code = F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), shared + 1, 6)), 12, "0")
        return F.coalesce(F.conv(code, 16, 10).cast("double"), F.lit(-1.0))
    return F.coalesce(value.cast("double"), F.lit(-1.0))


def shared_bytes(df: DataFrame, dims: dict[str, Column]) -> dict[str, int]:
    """Length of the beginning that all strings of a dimension share: that of the least and the greatest."""
    if not dims:
        return {}
    ends = df.agg(*[f(F.encode(c, "UTF-8")).alias(f"{x}_{n}") for n, c in dims.items() for x, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for n in dims:
        lo, hi = bytes(ends[f"lo_{n}"] or b""), bytes(ends[f"hi_{n}"] or b"")
        out[n] = next((i for i, (a, b) in enumerate(zip(lo, hi, strict=False)) if a != b), min(len(lo), len(hi)))
    return out


def curve_order(df: DataFrame, dims: dict[str, Column], bits: int = 4) -> Column:
    """Column with the place of each row's cell along the curve."""
    kinds = dict(df.select(*[c.alias(n) for n, c in dims.items()]).dtypes)
    shared = shared_bytes(df, {n: c for n, c in dims.items() if kinds[n] == "string"})
    keys = {n: order_key(c, kinds[n], shared.get(n, 0)) for n, c in dims.items()}
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(k, cuts, 2000).alias(n) for n, k in keys.items()]).first()  # 15 numbers a dimension
    cell: Column = F.lit(0)
    for n, k in keys.items():
        levels = sorted(set(found[n] or []))
        step: Column = F.lit(0)
        for i, level in enumerate(levels):
            step = F.when(k > level, i + 1).otherwise(step)
        cell = cell * (1 << bits) + step
    return F.element_at(F.array(*[F.lit(v) for v in curve_table(len(dims), bits)]), cell + 1)


def shard_rows(df: DataFrame, curve: Column, tie: list[Column], shards: int = 16, shard: str = "shard", slot: str = "slot", place: str = "curve") -> DataFrame:
    """df with shard, slot (gapless from 0 in each shard) and curve index; counts differ by one at most."""
    rows = df.withColumn(place, curve.cast("int"))
    # a row a cell of the curve, MAX_CELLS at most
    parts = rows.groupBy(place).agg(F.ceil(F.count(F.lit(1)) / F.lit(BUCKET_ROWS)).alias("__parts"))
    salt = F.pmod(F.xxhash64(*tie), F.col("__parts")).cast("bigint")
    rows = rows.join(F.broadcast(parts), place).withColumn("__bucket", F.col(place).cast("bigint") * F.lit(1 << 40) + salt).drop("__parts")
    sizes = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    # a row a bucket: MAX_CELLS and one for every BUCKET_ROWS rows at most
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(whole).alias("__total"))
    inside = Window.partitionBy("__bucket").orderBy(*tie)
    ranked = rows.withColumn("__rank", F.row_number().over(inside).cast("bigint")).join(F.broadcast(starts), "__bucket")
    rank = F.col("__start") + F.col("__rank") - 1
    base, more = F.expr(f"__total div {shards}"), F.col("__total") % shards
    edge = more * (base + 1)
    number = F.when(rank < edge, F.expr(f"(__start + __rank - 1) div (__total div {shards} + 1)")).otherwise(more + F.floor((rank - edge) / F.greatest(base, F.lit(1))))
    first = F.col(shard) * base + F.least(F.col(shard).cast("bigint"), more)
    return ranked.withColumn("__g", rank).withColumn(shard, number.cast("int")).withColumn(slot, (F.col("__g") - first).cast("bigint")).drop("__bucket", "__start", "__total", "__rank", "__g")


def document_shards(docs: DataFrame, shards: int = 16, bits: int = 4) -> DataFrame:
    """Documents over shards by length, source and language: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(data) + 1).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32"), "source", "lang")
    dims = {"size": F.log2(F.col("size")), "source": F.col("source"), "lang": F.col("lang")}
    cut = shard_rows(rows, curve_order(rows, dims, bits), [F.col("doc_id"), F.col("text_crc32")], shards)
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(cut: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order, so that files carry narrow ranges of every dimension.

    A shard is one task's, so give as many shards as files of the wanted size are needed.
    """
    cut.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
