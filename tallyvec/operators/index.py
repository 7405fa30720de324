"""The inverted index: lists by cell, their statistics, metadata; saving, loading, validation.

A saved index is a folder of versions and a file ``CURRENT`` that names the one in force.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import lane_names
from ..plans.config import EngineConfig
from . import train
from .staging import staged

MAGIC, VERSION, CURRENT = "TVIX", 1, "CURRENT"


@dataclass
class Index:
    config: EngineConfig
    centroids: DataFrame  # cell, c0...
    lists: DataFrame  # cell, ref_id, q0..., label
    stats: DataFrame  # cell, list_size, blocks, block_offset
    meta: DataFrame  # one row
    _cells: list = field(default_factory=list, repr=False)

    def cells(self) -> train.Cells:
        """The centroids on the driver, read once."""
        if not self._cells:
            self._cells.append(train.Cells.of(self.centroids, self.config.dims))
        return self._cells[0]


def list_sizes(assigned: DataFrame, k: int) -> DataFrame:
    """cell, list_size for every cell, also empty ones."""
    cells = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cell"))
    return cells.join(assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("list_size")), "cell", "left").select("cell", F.coalesce("list_size", F.lit(0)).cast("bigint").alias("list_size"))


def block_offsets(sizes: DataFrame, width: int = 8) -> DataFrame:
    """sizes with blocks and block_offset, the blocks of all cells before; k rows at most."""
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    blocks = F.ceil(F.col("list_size") / width).cast("bigint")
    return sizes.withColumn("blocks", blocks).withColumn("block_offset", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("bigint"))


def block_slots(assigned: DataFrame, width: int = 8) -> DataFrame:
    """cell, ref_id, block, slot: places inside the lists, in input order."""
    place = F.row_number().over(Window.partitionBy("cell").orderBy("ref_id")) - 1
    return assigned.select("cell", "ref_id", place.alias("__p")).select("cell", "ref_id", F.expr(f"__p div {width}").cast("bigint").alias("block"), (F.col("__p") % width).cast("bigint").alias("slot"))


def list_stats(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.sum((F.col("list_size") > 0).cast("bigint")).alias("non_empty"), F.min("list_size").alias("smallest"), F.max("list_size").alias("largest"), F.avg("list_size").alias("average"))


def dim_major(centroids: DataFrame, dims: int) -> DataFrame:
    """cell, dim, lane: the transposed centroid table."""
    pairs = F.array(*[F.struct(F.lit(i).alias("dim"), F.col(n).alias("lane")) for i, n in enumerate(lane_names(dims, "c"))])
    return centroids.select("cell", F.explode(pairs).alias("p")).select("cell", "p.dim", "p.lane")


def build(refs: DataFrame, config: EngineConfig, centroids: DataFrame | None = None) -> Index:
    """Train on a sample (unless centroids are given), assign all rows once, make lists and statistics."""
    n = refs.count()
    train.check_arguments(n, config.k, config.sample)
    if centroids is None:
        sample = train.sample_rows(refs, train.hash_key("ref_id", config.seed), config.sample)
        centroids = train.lloyd(sample, train.plus_plus_seeds(refs, config.k, config.dims, config.sample, config.seed), config.dims, config.iterations)
    return from_assigned(staged(train.assign(refs, centroids, config.dims)), centroids, config)


def from_assigned(assigned: DataFrame, centroids: DataFrame, config: EngineConfig) -> Index:
    lists = assigned.select("cell", "ref_id", *lane_names(config.dims), "label")
    stats = block_offsets(list_sizes(lists, config.k), config.block_width)
    counts = lists.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("fraud_count"))
    blocks = stats.agg(F.sum("blocks").alias("blocks"))
    meta = counts.crossJoin(blocks).select(  # one row each
        F.lit(MAGIC).alias("magic"), F.lit(VERSION).alias("version"), F.lit(config.dims).alias("dims"), F.lit(config.k).alias("k"), F.lit(config.block_width).alias("block_width"),
        "n", "fraud_count", (F.col("n") - F.col("fraud_count")).alias("legit_count"), "blocks", (F.col("blocks") * config.block_width).alias("padded"),
        F.lit(config.iterations).alias("iterations"), F.lit(str(config.seed)).alias("seed"), F.lit(config.scale).alias("scale"),
    )
    return Index(config, centroids, lists, stats, meta)


def save(index: Index, path: str) -> None:
    """Write a new version and then switch to it in one rename: readers see a whole index, the old or the new one.

    The version before stays for those who still read it; older ones and what broken runs left are deleted.
    """
    spark, path = index.lists.sparkSession, path.rstrip("/")
    jvm, conf, version = spark._jvm, spark._jsc.hadoopConfiguration(), f"v-{uuid.uuid4().hex}"
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    old = _current(spark, path)
    index.lists.repartition("cell").sortWithinPartitions("cell", "ref_id").write.partitionBy("cell").parquet(f"{path}/{version}/lists")
    for name in ("centroids", "stats", "meta"):
        getattr(index, name).coalesce(1).write.parquet(f"{path}/{version}/{name}")
    fresh = jvm.org.apache.hadoop.fs.Path(root, f"CURRENT-{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(root).toUri(), conf).rename(fs.makeQualified(fresh), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(root, CURRENT)), options)
    for status in fs.listStatus(root):
        if status.getPath().getName() not in (version, old, CURRENT):
            fs.delete(status.getPath(), True)


def _current(spark: SparkSession, path: str) -> str | None:
    """Name of the version in force."""
    jvm = spark._jvm
    pointer = jvm.org.apache.hadoop.fs.Path(jvm.org.apache.hadoop.fs.Path(path), CURRENT)
    fs = pointer.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(pointer):
        return None
    source = fs.open(pointer)
    name = jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    source.close()
    return name.strip()


def resolve(spark: SparkSession, path: str, fallback: str = "resources") -> str:
    """path, or only if it isn't there the same name below the fallback folder (of an absolute path: the fallback itself)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    other = fallback if "://" in path or path.startswith("/") else f"{fallback}/{path}"
    for p in (path, other):
        h = jvm.org.apache.hadoop.fs.Path(p)
        if h.getFileSystem(conf).exists(h):
            return p
    raise FileNotFoundError(path)


def load(spark: SparkSession, path: str, config: EngineConfig | None = None) -> Index:
    path = resolve(spark, path)
    version = _current(spark, path)
    if version is None:
        raise ValueError(f"{path} names no version")
    path = f"{path.rstrip('/')}/{version}"
    meta = spark.read.parquet(f"{path}/meta")
    m = meta.first()
    base = config or EngineConfig(k=m["k"], sample=max(m["k"], EngineConfig.sample))
    config = EngineConfig(**{**base.__dict__, "dims": m["dims"], "k": m["k"], "block_width": m["block_width"], "scale": m["scale"]})
    index = Index(config, spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/stats"), meta)
    validate(index)
    return index


def validate(index: Index) -> None:
    """Raise ValueError where metadata, statistics and lists don't agree."""
    m, c = index.meta.first(), index.config
    bad = []
    check = lambda ok, what: None if ok else bad.append(what)
    check(m["magic"] == MAGIC and m["version"] == VERSION, "magic or version")
    check(m["dims"] == c.dims and m["block_width"] == 8 and m["scale"] == 10_000, "dims, block width or scale")
    check(1 <= m["k"] <= train.MAX_K, "k")
    check(m["blocks"] > 0 and m["padded"] == m["blocks"] * m["block_width"], "blocks")
    check(m["fraud_count"] + m["legit_count"] == m["n"], "label counts")
    check(index.centroids.count() == m["k"], "centroids")
    s = index.stats.agg(F.count(F.lit(1)).alias("k"), F.sum("list_size").alias("n"), F.sum("blocks").alias("blocks"), F.min("block_offset").alias("first"), F.min(F.col("blocks") * m["block_width"] - F.col("list_size")).alias("room")).first()
    check(s["k"] == m["k"] and s["n"] == m["n"] and s["blocks"] == m["blocks"] and s["first"] == 0 and s["room"] >= 0, "list statistics")
    wrong = block_offsets(index.stats.select("cell", "list_size"), m["block_width"]).select("cell", F.col("block_offset").alias("o")).join(index.stats, "cell").filter("o <> block_offset")
    check(wrong.isEmpty(), "block offsets")
    lists = index.lists.groupBy("cell").agg(F.count(F.lit(1)).alias("__n")).join(index.stats.filter("list_size > 0"), "cell", "full").filter("__n is null or list_size is null or __n <> list_size")
    check(lists.isEmpty(), "lists")
    if bad:
        raise ValueError("broken index: " + ", ".join(bad))
