"""Training: sample, seeds, Lloyd rounds on integer lanes, assignment.

Distances and sums are integers, so results don't depend on how rows are dealt.  Centroids, 4096 at
most, go along with the task: nearest cells are found inside each Arrow batch by a blocked matrix
product, so that no row moves.  Products and sums of lanes stay below 2**53 and are exact in doubles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import half_away, lane_names, sq_dist_int
from .staging import staged

MAX_K = 4096
#: Distances that one step holds.
STEP_CELLS = 1 << 21


@dataclass(frozen=True)
class Cells:
    """Centroids on the driver (MAX_K rows at most), in the order of their cells."""

    cell: np.ndarray
    lanes: np.ndarray

    @classmethod
    def of(cls, centroids: DataFrame | Cells, dims: int) -> Cells:
        if isinstance(centroids, Cells):
            return centroids
        found = centroids.select("cell", *lane_names(dims, "c")).toPandas().sort_values("cell")
        if len(found) > MAX_K + 1:
            raise ValueError(f"more than {MAX_K} centroids")
        return cls(found["cell"].to_numpy(np.int64), found[lane_names(dims, "c")].to_numpy(np.float64))

    def nearest(self, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of the n nearest cells of each row, nearest first, the lower cell of equals."""
        n, k = min(n, len(self.cell)), len(self.cell)
        places, found = np.empty((len(rows), n), np.int64), np.empty((len(rows), n), np.int64)
        own = (self.lanes**2).sum(1)
        step = max(1, STEP_CELLS // max(1, k))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            d = ((part**2).sum(1)[:, None] + own - 2 * (part @ self.lanes.T)).astype(np.int64)
            if n == 1:
                at = d.argmin(1)[:, None]
            else:
                last = np.partition(d, n - 1, axis=1)[:, n - 1 : n]
                d2 = np.where(d <= last, d, np.iinfo(np.int64).max)  # of the rest no one is among the nearest
                at = d2.argsort(1, kind="stable")[:, :n]
            places[i : i + step], found[i : i + step] = at, np.take_along_axis(d, at, 1)
        return places, found


def lane_matrix(batch, names: list[str]) -> np.ndarray:
    """Lanes of a batch or table as doubles, a row a row."""
    out = np.empty((batch.num_rows, len(names)), np.float64)
    for j, name in enumerate(names):
        out[:, j] = batch.column(name).to_numpy()
    return out


def check_arguments(n: int, k: int, sample: int) -> None:
    if n <= 0 or not 1 <= k <= min(n, MAX_K) or sample < k:
        raise ValueError("need n > 0, 1 <= k <= min(n, 4096) and sample >= k")


def sample_rows(df: DataFrame, key: Column, limit: int) -> DataFrame:
    """Exactly min(n, limit) rows, those with the smallest keys: a uniform sample where the key is a hash."""
    return df.orderBy(key).limit(limit)


def hash_key(ref_id: str, seed: int) -> Column:
    return F.xxhash64(F.col(ref_id), F.lit(seed & 0x7FFFFFFFFFFFFFFF))


def first_seeds(refs: DataFrame, k: int, dims: int) -> DataFrame:
    """cell, c0...: the lanes of the k lowest ids."""
    rows = refs.orderBy("ref_id").limit(k)
    from pyspark.sql import Window

    cell = F.row_number().over(Window.orderBy("ref_id")) - 1  # k rows at most
    return rows.select(cell.alias("cell"), *[F.col(n).alias(m) for n, m in zip(lane_names(dims), lane_names(dims, "c"), strict=True)])


def plus_plus_seeds(refs: DataFrame, k: int, dims: int, sample: int, seed: int) -> DataFrame:
    """k-means++ over a bounded sample (sample rows at most), drawn and seeded on the driver."""
    spark = refs.sparkSession
    data = sample_rows(refs, hash_key("ref_id", seed), sample).select(*lane_names(dims)).toPandas().to_numpy(np.float64)
    rng = np.random.default_rng(seed)
    picked = [int(rng.integers(len(data)))]
    near = ((data - data[picked[0]]) ** 2).sum(1)
    for c in range(1, k):
        total = near.sum()
        i = int(np.searchsorted(np.cumsum(near), rng.random() * total)) if total > 0 else c % len(data)
        picked.append(min(i, len(data) - 1))
        near = np.minimum(near, ((data - data[picked[-1]]) ** 2).sum(1))
    rows = [(c, *map(int, data[i])) for c, i in enumerate(picked)]
    return spark.createDataFrame(rows, "cell int, " + ", ".join(f"{n} bigint" for n in lane_names(dims, "c")))


def centroid_distances(rows: DataFrame, centroids: DataFrame, dims: int) -> DataFrame:
    """rows x centroids with d; centroids are MAX_K rows at most."""
    q, c = [[F.col(n) for n in lane_names(dims, p)] for p in ("q", "c")]
    return rows.crossJoin(F.broadcast(centroids)).withColumn("d", sq_dist_int(q, c))


def assign(rows: DataFrame, centroids: DataFrame | Cells, dims: int, before: Cells | None = None) -> DataFrame:
    """rows with the nearest cell and its distance; with cells from before, moved says whether the cell is another one."""
    cells, names = Cells.of(centroids, dims), lane_names(dims)
    kept = [c for c in rows.columns if c not in ("cell", "cell_distance", "moved")]
    source = rows.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", cell int, cell_distance bigint" + (", moved boolean" if before else "")

    def run(batches):
        for b in batches:
            lanes = lane_matrix(b, names)
            at, d = cells.nearest(lanes, 1)
            more = [pa.array(cells.cell[at[:, 0]].astype(np.int32)), pa.array(d[:, 0])]
            if before:
                more.append(pa.array(before.cell[before.nearest(lanes, 1)[0][:, 0]] != cells.cell[at[:, 0]]))
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*kept, "cell", "cell_distance", "moved"][: len(kept) + len(more)])

    return source.mapInArrow(run, schema)


def update(assigned: DataFrame, centroids: DataFrame, dims: int) -> DataFrame:
    """Means of the cells; an empty cell keeps its centroid."""
    q, c = lane_names(dims), lane_names(dims, "c")
    sums = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(n).alias(n) for n in q])
    joined = centroids.join(F.broadcast(sums), "cell", "left")  # as many rows as there are centroids
    return joined.select("cell", *[F.coalesce(half_away(F.col(a), F.col("__n")), F.col(b)).alias(b) for a, b in zip(q, c, strict=True)])


def changed_count(before: DataFrame, after: DataFrame, key: str = "ref_id") -> DataFrame:
    old = before.select(key, F.col("cell").alias("old"))
    return after.join(old, key, "left").agg(F.sum((~F.col("cell").eqNullSafe(F.col("old"))).cast("bigint")).alias("changed"))


def mean_lane(total: int, n: int) -> int:
    """total / n rounded half away from zero."""
    return (1 if total >= 0 else -1) * ((2 * abs(total) + n) // (2 * n))


def lloyd(sample: DataFrame, centroids: DataFrame, dims: int, iterations: int) -> DataFrame:
    """Rounds of assign and update, until fewer than a thousandth of the rows change cells.

    The sample (bounded by its parameter) is written once; a round is one pass over it that sums up
    each cell and counts the rows which the last round's centroids had put elsewhere.  Sums of MAX_K
    cells at most come to the driver.
    """
    spark, names, schema = sample.sparkSession, lane_names(dims), centroids.schema
    sample = staged(sample.select("ref_id", *names))
    size, before, cells = sample.count(), None, Cells.of(centroids, dims)
    for _ in range(iterations):
        now = assign(sample, cells, dims, before)
        moved = F.sum(F.col("moved").cast("bigint")) if before else F.count(F.lit(1))
        sums = now.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), moved.alias("moved"), *[F.sum(c).alias(c) for c in names]).collect()
        place = {int(c): i for i, c in enumerate(cells.cell)}
        lanes = cells.lanes.copy()  # an empty cell keeps its centroid
        for r in sums:
            lanes[place[r["cell"]]] = [mean_lane(r[c], r["n"]) for c in names]
        before, cells = cells, Cells(cells.cell, lanes)
        if sum(r["moved"] for r in sums) * 1000 < size:
            break
    return spark.createDataFrame([(int(c), *map(int, v)) for c, v in zip(cells.cell, cells.lanes, strict=True)], schema)


def mllib_centroids(refs: DataFrame, k: int, dims: int, iterations: int, seed: int) -> DataFrame:
    """Centroids by Spark's own k-means||, rounded to lanes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=lane_names(dims), outputCol="features").transform(refs)
    model = KMeans(k=k, maxIter=iterations, seed=seed & 0x7FFFFFFF).fit(data)
    rows = [(i, *[int(round(x)) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return refs.sparkSession.createDataFrame(rows, "cell int, " + ", ".join(f"{n} bigint" for n in lane_names(dims, "c")))
