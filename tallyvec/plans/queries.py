"""Queries of the engine and their SQL for DuckDB.

Searches over embeddings take every vector as a query against all others; payload searches take the
events whose id is divisible by 20 as queries and every event but the query's own as the reference set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions.expr import OTHER_RISK, lane_names, mcc_risk
from ..operators import decide, features, index, search, train
from ..operators.staging import staged, work_dir
from ..sources.references import label_counts, read_references
from ..streaming.score import score_stream
from .config import EngineConfig
from .engine import Engine
from .fixtures import DIMS, EMB, EV, K, embedding_refs, event_payloads, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
EMB_CONFIG = EngineConfig(dims=DIMS, k=K, nprobe_fast=2, nprobe_full=4)
EV_CONFIG = EngineConfig(dims=14, k=K, nprobe_fast=2, nprobe_full=4)
#: Probes at which a trained index of the embeddings finds 0.9 of the true neighbours at least; see trained_index_recall.
TRAINED_CONFIG = EngineConfig(dims=DIMS, k=K, nprobe_fast=12, nprobe_full=16)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


# --- SQL pieces


def _names(p: str, dims: int, table: str = "") -> str:
    return ", ".join(f"{table}{p}{i}" for i in range(dims))


def _dist(a: str, b: str, dims: int, bp: str = "q") -> str:
    return "(" + " + ".join(f"({a}.q{i} - {b}.{bp}{i}) * ({a}.q{i} - {b}.{bp}{i})" for i in range(dims)) + ")"


def _seeds(rows: str, dims: int) -> str:
    return "c AS (SELECT CAST(row_number() OVER (ORDER BY ref_id) - 1 AS BIGINT) AS cell, " + ", ".join(f"q{i} AS c{i}" for i in range(dims)) + f" FROM (SELECT * FROM {rows} ORDER BY ref_id LIMIT {K}))"


def _assigned(rows: str, dims: int, name: str = "a", cells: str = "c") -> str:
    return f"{name}_d AS (SELECT ref_id, cell, {_dist('x', 'y', dims, 'c')} AS d FROM {rows} x, {cells} y), {name}_n AS (SELECT ref_id, cell, d, row_number() OVER (PARTITION BY ref_id ORDER BY d, cell) AS n FROM {name}_d), {name} AS (SELECT x.*, cell, d AS cell_distance FROM {rows} x JOIN {name}_n USING (ref_id) WHERE n = 1)"


def _updated(dims: int, name: str = "u", rows: str = "a", cells: str = "c") -> str:
    mean = lambda i: f"coalesce(CAST(sign(s{i}) * floor((2 * abs(s{i}) + n) / (2.0::DOUBLE * n)) AS BIGINT), c{i}) AS c{i}"
    return f"{name} AS (SELECT y.cell, " + ", ".join(mean(i) for i in range(dims)) + f" FROM {cells} y LEFT JOIN (SELECT cell, count(*) AS n, " + ", ".join(f"CAST(sum(q{i}) AS BIGINT) AS s{i}" for i in range(dims)) + f" FROM {rows} GROUP BY cell) g ON y.cell = g.cell)"


def _probes(queries: str, dims: int, nprobe: int) -> str:
    return f"p AS (SELECT * FROM (SELECT ref_id AS qid, cell, row_number() OVER (PARTITION BY ref_id ORDER BY {_dist('x', 'y', dims, 'c')}, cell) AS probe FROM {queries} x, c y) WHERE probe <= {nprobe})"


def _count(queries: str, lists: str, dims: int, nprobe: int, name: str, own: bool, where: str = "TRUE") -> str:
    other = "x.ref_id <> r.ref_id" if own else "TRUE"
    return f"""{name}_k AS (SELECT qid, r.ref_id, r.label, {_dist('x', 'r', dims)} AS d FROM p JOIN {queries} x ON x.ref_id = p.qid JOIN {lists} r ON r.cell = p.cell WHERE probe <= {nprobe} AND {other} AND {where}),
{name} AS (SELECT ref_id AS qid, CAST(coalesce(n, 0) AS BIGINT) AS fraud_count FROM {queries} LEFT JOIN (SELECT qid, sum(label) AS n FROM (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY d, ref_id) AS rank FROM {name}_k) WHERE rank <= 5 GROUP BY qid) g ON ref_id = g.qid)"""


EMB_INDEX = f"WITH {EMB}, {_seeds('e', DIMS)}, {_assigned('e', DIMS)}"
#: Every event is a reference; a query leaves out its own row only.
EV_ALL = f"WITH {EV}, q AS (SELECT event_id AS ref_id, {_names('q', 14)} FROM f WHERE event_id % 20 = 0), r0 AS (SELECT event_id AS ref_id, label, {_names('q', 14)} FROM f), {_seeds('r0', 14)}, {_assigned('r0', 14)}, {_probes('q', 14, 4)}, {_count('q', 'a', 14, 2, 'fast', True)}, {_count('q', 'a', 14, 4, 'full_', True)}, two AS (SELECT qid, fast.fraud_count AS fast_count, CASE WHEN fast.fraud_count IN (2, 3) THEN full_.fraud_count ELSE fast.fraud_count END AS fraud_count FROM fast JOIN full_ USING (qid))"
DECISION = "fraud_count / 5.0::DOUBLE AS fraud_score, fraud_count < 3 AS approved"


# --- fixtures


def small(centroids: DataFrame) -> DataFrame:
    """A local table of a bounded one (K rows)."""
    return centroids.sparkSession.createDataFrame(centroids.collect(), centroids.schema)


def emb_index(spark: SparkSession, sf_dir: str):
    refs = embedding_refs(spark, sf_dir)
    seeds = small(train.first_seeds(refs, K, DIMS))
    return refs, seeds, train.assign(refs, seeds, DIMS)


def emb_queries(refs: DataFrame) -> DataFrame:
    return refs.select(F.col("ref_id").alias("qid"), *lane_names(DIMS))


def ev_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.vectorize(P.parse_payload(event_payloads(spark, sf_dir)))


def ev_tables(payloads: DataFrame):
    """Queries, the index of every event, and the queries' payloads (event_id, value)."""
    rows = features.vectorize(P.parse_payload(payloads))
    # the reference set and its cells are written once: training and search read them several times
    asked = F.when(F.col("event_id") % 20 == 0, F.col("value")).alias("value")
    kept = staged(rows.select(F.col("event_id").alias("ref_id"), *lane_names(14), "label", asked))
    refs = kept.drop("value")
    seeds = small(train.first_seeds(refs, K, 14))
    built = index.from_assigned(staged(train.assign(refs, seeds, 14)), seeds, EV_CONFIG)
    own = kept.filter("ref_id % 20 = 0")
    return own.select(F.col("ref_id").alias("qid"), *lane_names(14)), built, own.select(F.col("ref_id").alias("event_id"), "value")


def ev_index(spark: SparkSession, sf_dir: str):
    """Queries and the index of every event."""
    return ev_tables(event_payloads(spark, sf_dir))[:2]


# --- payloads and features


@query(f"WITH {EV} SELECT event_id, TRUE AS is_valid, CAST(least(event_id % 15, 12) AS BIGINT) AS installments, CAST(least(tx_count_24h, 20) AS BIGINT) AS tx_count_24h, last_ts IS NOT NULL AS has_last_tx FROM ev2")
def payload_parse_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_payload(event_payloads(spark, sf_dir)).select("event_id", "is_valid", "installments", "tx_count_24h", "has_last_tx")


#: (name, pattern, replacement) of the ways to break a payload.
BROKEN = [
    ("json", r"^[{]", ""), ("id", r'"id":"(tx-\d+)"', '"id":7'), ("amount", r'"amount":([^,]*)', '"amount":"1"'), ("amount", r'"amount":([^,]*)', '"amount":1e39'),
    ("installments", r'"installments":', '"installments":-'), ("requested_at", r'"requested_at":"[^"]*"', '"requested_at":"2026-02-29T10:00:00Z"'),
    ("requested_at", r'"requested_at":"[^"]*"', '"requested_at":"2026-02-28T24:00:00Z"'), ("last_transaction", r'"last_transaction":', '"other":'),
    ("mcc", r'"mcc":"[^"]*"', '"mcc":"x"'), ("is_online", r'"is_online":(true|false)', '"is_online":1'), ("merchant.id", r'"merchant":[{]"id":"[^"]*"', '"merchant":{"id":5'),
]
_broken = ", ".join(f"({i})" for i in range(len(BROKEN)))


@query(f"{EV_ALL} SELECT event_id, CAST(v AS INT) AS variant, 'parse_error' AS status, 0.0::DOUBLE AS fraud_score, TRUE AS approved FROM events, (VALUES {_broken}) t(v) WHERE NOT (v = 4 AND event_id % 15 = 0) UNION ALL SELECT qid, -1, 'ok', {DECISION} FROM two")
def payload_parse_invalid_fail_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken payloads of every event, and the whole ones of the queries (variant -1), through the engine."""
    rows = staged(event_payloads(spark, sf_dir))
    kinds = F.array(*[F.struct(F.lit(i).alias("variant"), F.regexp_replace("value", pattern, text).alias("value")) for i, (_, pattern, text) in enumerate(BROKEN)])
    broken = rows.select("event_id", F.explode(kinds).alias("b")).select("event_id", "b.variant", "b.value").filter("not (variant = 4 and event_id % 15 = 0)")  # minus nought is nought
    whole = rows.filter("event_id % 20 = 0").select("event_id", F.lit(-1).alias("variant"), "value")
    # a broken payload's key is that of no reference
    asked = broken.unionByName(whole).withColumn("key", F.when(F.col("variant") < 0, F.col("event_id")).otherwise(-(F.col("event_id") * len(BROKEN) + F.col("variant") + 1)))
    scored = Engine(ev_tables(rows)[1]).score(asked, "key", leave_out_self=True)
    whole_key = F.col("key") >= 0
    return scored.select(F.when(whole_key, F.col("key")).otherwise(F.expr(f"(-key - 1) div {len(BROKEN)}")).alias("event_id"), F.when(whole_key, -1).otherwise((-F.col("key") - 1) % len(BROKEN)).cast("int").alias("variant"), "status", "fraud_score", "approved")


@query("SELECT event_id, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS weekday FROM events")
def ts_parts_hour_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = P.iso_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return read(spark, sf_dir, "events").select("event_id", P.hour_of(at).alias("hour"), P.monday_based_day(at).alias("weekday"))


@query(f"WITH {EV} SELECT event_id, minutes AS minutes_since_last FROM ev2")
def minutes_since_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_payload(event_payloads(spark, sf_dir)).select("event_id", "minutes_since_last")


@query(f"WITH {EV} SELECT event_id, unknown AS is_unknown_merchant FROM ev2")
def unknown_merchant_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_payload(event_payloads(spark, sf_dir)).select("event_id", "is_unknown_merchant")


@query(f"WITH {EV} SELECT event_id, CAST(mcc AS BIGINT) AS mcc, q12 / 10000.0::DOUBLE AS risk FROM ev2 JOIN f USING (event_id)")
def mcc_scan_and_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_payload(event_payloads(spark, sf_dir)).select("event_id", "mcc", F.coalesce(mcc_risk(F.col("mcc")), F.lit(OTHER_RISK)).alias("risk"))


@query(f"WITH {EV} SELECT least(event_id % 15, 12) AS installments, least(tx_count_24h, 20) AS tx_count_24h, count(*) AS n FROM ev2 GROUP BY 1, 2")
def caps_installments_txcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_payload(event_payloads(spark, sf_dir)).groupBy("installments", "tx_count_24h").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT event_id, " + ", ".join(f"CAST(q{i} AS BIGINT) AS q{i}" for i in range(14)) + " FROM f")
def feature_lanes_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev_rows(spark, sf_dir).select("event_id", *lane_names(14))


# --- references, training, index


@query(f"WITH {EMB} SELECT CAST(sum(label) AS BIGINT) AS fraud_count, CAST(sum(1 - label) AS BIGINT) AS legit_count, count(*) AS n FROM e")
def reference_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_counts(embedding_refs(spark, sf_dir)).select(*big("fraud_count", "legit_count", "n"))


@query("SELECT vec_id AS ref_id FROM embeddings ORDER BY (vec_id * 2654435761) % 4294967296, vec_id LIMIT 128")
def reservoir_sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct((F.col("ref_id") * 2654435761) % 4294967296, F.col("ref_id"))
    return train.sample_rows(embedding_refs(spark, sf_dir).select("ref_id"), key, 128)


@query(f"WITH {EMB} SELECT ref_id, {_names('q', DIMS)} FROM e")
def quantize_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_refs(spark, sf_dir).select("ref_id", *lane_names(DIMS))


@query(f"{EMB_INDEX} SELECT ref_id, CAST(cell AS BIGINT) AS cell, CAST(cell_distance AS BIGINT) AS cell_distance FROM a")
def assign_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_index(spark, sf_dir)[2].select("ref_id", *big("cell", "cell_distance"))


@query(f"{EMB_INDEX}, {_updated(DIMS)} SELECT CAST(cell AS BIGINT) AS cell, {_names('c', DIMS)} FROM u")
def lloyd_one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, seeds, assigned = emb_index(spark, sf_dir)
    return train.update(assigned, seeds, DIMS).select(*big("cell"), *lane_names(DIMS, "c"))


_far = "c2 AS (SELECT * FROM c UNION ALL SELECT 16, " + ", ".join(["1000000"] * DIMS) + ")"


@query(f"WITH {EMB}, {_seeds('e', DIMS)}, {_far}, {_assigned('e', DIMS, 'a', 'c2')}, {_updated(DIMS, 'u', 'a', 'c2')} SELECT CAST(cell AS BIGINT) AS cell, CAST(c0 AS BIGINT) AS c0, CAST(c63 AS BIGINT) AS c63 FROM u")
def lloyd_empty_cell_keeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, seeds, _ = emb_index(spark, sf_dir)
    far = spark.range(1).select(F.lit(16).alias("cell"), *[F.lit(1_000_000).cast("bigint").alias(n) for n in lane_names(DIMS, "c")])
    cells = seeds.unionByName(far)
    return train.update(train.assign(refs, cells, DIMS), cells, DIMS).select(*big("cell", "c0", "c63"))


@query(f"{EMB_INDEX}, {_updated(DIMS)}, {_assigned('e', DIMS, 'b', 'u')} SELECT CAST(sum(CASE WHEN a.cell <> b.cell THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM a JOIN b USING (ref_id)")
def lloyd_converged_changed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, seeds, assigned = emb_index(spark, sf_dir)
    return train.changed_count(assigned, train.assign(refs, train.update(assigned, seeds, DIMS), DIMS)).select(*big("changed"))


_sizes = f"s AS (SELECT g.i AS cell, count(ref_id) AS list_size FROM range({K}) g(i) LEFT JOIN a ON a.cell = g.i GROUP BY 1)"


@query(f"{EMB_INDEX}, {_sizes} SELECT CAST(cell AS BIGINT) AS cell, list_size FROM s")
def cell_histogram_with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.list_sizes(emb_index(spark, sf_dir)[2], K).select(*big("cell", "list_size"))


@query(f"{EMB_INDEX}, {_sizes} SELECT CAST(cell AS BIGINT) AS cell, (list_size + 7) // 8 AS blocks, CAST(coalesce(sum((list_size + 7) // 8) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_offset FROM s")
def block_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.block_offsets(index.list_sizes(emb_index(spark, sf_dir)[2], K)).select(*big("cell", "blocks", "block_offset"))


@query(f"{EMB_INDEX}, {_sizes} SELECT count(*) FILTER (list_size > 0) AS non_empty, min(list_size) AS smallest, max(list_size) AS largest, avg(list_size) AS average FROM s")
def list_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.list_stats(index.list_sizes(emb_index(spark, sf_dir)[2], K))


@query(f"{EMB_INDEX}, n AS (SELECT cell, ref_id, row_number() OVER (PARTITION BY cell ORDER BY ref_id) - 1 AS i FROM a) SELECT CAST(cell AS BIGINT) AS cell, ref_id, i // 8 AS block, i % 8 AS slot FROM n")
def block_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.block_slots(emb_index(spark, sf_dir)[2]).select(*big("cell", "ref_id", "block", "slot"))


@query(f"{EMB_INDEX} " + " UNION ALL ".join(f"SELECT cell, CAST({i} AS BIGINT) AS dim, c{i} AS lane FROM c" for i in range(DIMS)))
def centroids_dim_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.dim_major(emb_index(spark, sf_dir)[1], DIMS).select(*big("cell", "dim", "lane"))


# --- search


@query(f"{EMB_INDEX} SELECT ref_id AS qid, cell, CAST(d AS BIGINT) AS d FROM a_d")
def centroid_distance_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, seeds, _ = emb_index(spark, sf_dir)
    return train.centroid_distances(emb_queries(refs), seeds, DIMS).select(*big("qid", "cell", "d"))


@query(f"{EMB_INDEX}, {_probes('e', DIMS, 4)} SELECT qid, CAST(cell AS BIGINT) AS cell, probe FROM p")
def probe_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, seeds, _ = emb_index(spark, sf_dir)
    return search.probes(emb_queries(refs), seeds, DIMS, 4).select(*big("qid", "cell", "probe"))


@query(f"{EMB_INDEX}, {_probes('e', DIMS, 2)} SELECT qid, count(*) AS candidates, CAST(sum({_dist('x', 'r', DIMS)}) AS BIGINT) AS total FROM p JOIN e x ON x.ref_id = qid JOIN a r ON r.cell = p.cell GROUP BY qid")
def ivf_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, seeds, assigned = emb_index(spark, sf_dir)
    found = search.candidates(search.probes(emb_queries(refs), seeds, DIMS, 2), assigned, DIMS)
    return found.groupBy("qid").agg(F.count(F.lit(1)).alias("candidates"), F.sum("d").alias("total"))


@query(f"WITH {EMB} SELECT * FROM (SELECT x.ref_id AS qid, r.ref_id, {_dist('x', 'r', DIMS)} AS d, row_number() OVER (PARTITION BY x.ref_id ORDER BY {_dist('x', 'r', DIMS)}, r.ref_id) AS rank FROM e x, e r WHERE x.ref_id <> r.ref_id) WHERE rank <= 5")
def knn5_bruteforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = embedding_refs(spark, sf_dir)
    return search.nearest(search.brute_force(emb_queries(refs), refs, DIMS, leave_out_self=True)).select(*big("qid", "ref_id", "d", "rank"))


@query(f"{EMB_INDEX}, {_probes('e', DIMS, 2)}, {_count('e', 'a', DIMS, 2, 'fast', True)} SELECT * FROM fast")
def ivf_fraud_count_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, seeds, assigned = emb_index(spark, sf_dir)
    queries = emb_queries(refs)
    found = search.nearest_by_cell(search.probes(queries, seeds, DIMS, 2), assigned, DIMS, leave_out_self=True)
    return search.fraud_counts(queries, found)


EMB_TWO = f"{EMB_INDEX}, {_probes('e', DIMS, 4)}, {_count('e', 'a', DIMS, 2, 'fast', True)}, {_count('e', 'a', DIMS, 4, 'full_', True)}, two AS (SELECT qid, fast.fraud_count AS fast_count, CASE WHEN fast.fraud_count IN (2, 3) THEN full_.fraud_count ELSE fast.fraud_count END AS fraud_count FROM fast JOIN full_ USING (qid))"


@query(f"{EMB_TWO} SELECT * FROM two")
def ivf_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, seeds, assigned = emb_index(spark, sf_dir)
    return search.two_pass(emb_queries(refs), index.from_assigned(assigned, seeds, EMB_CONFIG), leave_out_self=True)


MANY_CELLS = 256


@query(f"WITH {EMB}, {_seeds('e', DIMS).replace(f'LIMIT {K}', f'LIMIT {MANY_CELLS}')}, {_assigned('e', DIMS)}, {_probes('e', DIMS, 1)}, {_count('e', 'a', DIMS, 1, 'fast', True)} SELECT * FROM fast")
def underfull_topk_counts_legit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """So many cells that lists have fewer than five rows: the missing neighbours count as legitimate."""
    refs = embedding_refs(spark, sf_dir)
    seeds = small(train.first_seeds(refs, MANY_CELLS, DIMS))
    queries = emb_queries(refs)
    found = search.nearest_by_cell(search.probes(queries, seeds, DIMS, 1), train.assign(refs, seeds, DIMS), DIMS, leave_out_self=True)
    return search.fraud_counts(queries, found)


@query(f"WITH {EMB}, k AS (SELECT x.ref_id AS qid, r.ref_id, r.label, {_dist('x', 'r', DIMS)} AS d FROM e x, e r WHERE x.ref_id <> r.ref_id), b AS (SELECT qid, sum(label) AS n FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, ref_id) AS rank FROM k) WHERE rank <= 5 GROUP BY qid), {EMB_TWO.split(EMB + ', ', 1)[1]} SELECT count(*) AS queries, count(*) FILTER (b.n = two.fraud_count) AS same_count, count(*) FILTER ((b.n < 3) = (two.fraud_count < 3)) AS same_decision FROM b JOIN two USING (qid)")
def recall_vs_bruteforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = embedding_refs(spark, sf_dir)
    exact = search.fraud_counts(emb_queries(refs), search.brute_force(emb_queries(refs), refs, DIMS, leave_out_self=True)).withColumnRenamed("fraud_count", "n")
    both = exact.join(ivf_two_pass(spark, sf_dir), "qid")
    return both.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("n") == F.col("fraud_count")).alias("same_count"), F.count_if((F.col("n") < 3) == (F.col("fraud_count") < 3)).alias("same_decision"))


def trained_search(refs: DataFrame) -> DataFrame:
    """The nearest five that the fast pass finds in an index with the operator's own training."""
    built = index.build(refs, TRAINED_CONFIG)
    probed = search.probes(emb_queries(refs), built.centroids, DIMS, TRAINED_CONFIG.nprobe_fast)
    return search.nearest(search.nearest_by_cell(staged(probed), staged(built.lists), DIMS, leave_out_self=True))


@query()
def trained_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample, k-means++ and Lloyd rounds, then every vector against all others; the sample's hash has no SQL form."""
    return trained_search(staged(embedding_refs(spark, sf_dir))).select(*big("qid", "ref_id", "d", "rank"))


@query()
def trained_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True neighbours (the five of each query by brute force) and those among them that trained_index_search finds."""
    refs = staged(embedding_refs(spark, sf_dir))
    exact = search.nearest(search.brute_force(emb_queries(refs), refs, DIMS, leave_out_self=True)).select("qid", "ref_id")
    found = trained_search(refs).select("qid", "ref_id", F.lit(1).alias("hit"))
    both = exact.join(found, ["qid", "ref_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


# --- decisions and the whole way


@query("SELECT CAST(i AS BIGINT) AS fraud_count, least(greatest(i, 0), 5) / 5.0::DOUBLE AS fraud_score, i < 3 AS approved FROM range(-1, 8) t(i)")
def decision_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.decide(spark.range(-1, 8).withColumnRenamed("id", "fraud_count")).select("fraud_count", "fraud_score", "approved")


@query(f"{EV_ALL} SELECT qid, '{{\"approved\":' || CASE WHEN fraud_count < 3 THEN 'true' ELSE 'false' END || ',\"fraud_score\":' || ['0.0', '0.2', '0.4', '0.6', '0.8', '1'][CAST(fraud_count + 1 AS INT)] || '}}' AS body FROM two")
def response_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, built = ev_index(spark, sf_dir)
    return decide.decide(search.two_pass(queries, built, leave_out_self=True)).select("qid", "body")


@query(f"{EV_ALL} SELECT qid AS event_id, 'ok' AS status, fraud_count, {DECISION} FROM two")
def score_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, built, asked = ev_tables(event_payloads(spark, sf_dir))
    return Engine(built).score(asked, "event_id", leave_out_self=True).select("event_id", "status", "fraud_count", "fraud_score", "approved")


@query(f"{EV_ALL} SELECT qid AS event_id, fast_count, fraud_count, {DECISION} FROM two")
def score_against_all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by an index of every event, where a query leaves out its own row only."""
    queries, built = ev_index(spark, sf_dir)
    return decide.decide(search.two_pass(queries, built, leave_out_self=True)).select(F.col("qid").alias("event_id"), "fast_count", "fraud_count", "fraud_score", "approved")


def _dist_f32(dims: int) -> str:
    step = lambda i: f"(x.q{i}::FLOAT * 0.0001::FLOAT - r.q{i}::FLOAT * 0.0001::FLOAT)"
    out = f"{step(0)} * {step(0)}"
    for i in range(1, dims):
        out = f"({out} + {step(i)} * {step(i)})"
    return out


SLOTS = f"""WITH RECURSIVE {EMB_INDEX.removeprefix('WITH ')}, {_probes('e', DIMS, 2)},
k AS (SELECT qid, r.label, row_number() OVER (PARTITION BY qid ORDER BY probe, r.ref_id) AS i, CAST({_dist_f32(DIMS)} AS DOUBLE) AS d FROM p JOIN e x ON x.ref_id = p.qid JOIN a r ON r.cell = p.cell WHERE x.ref_id <> r.ref_id),
s AS (SELECT ref_id AS qid, CAST(0 AS BIGINT) AS i, [1e30, 1e30, 1e30, 1e30, 1e30]::DOUBLE[] AS ds, [0, 0, 0, 0, 0]::INT[] AS ls FROM e
UNION ALL SELECT s.qid, k.i, CASE WHEN k.d < list_max(ds) THEN ds[1:list_position(ds, list_max(ds)) - 1] || [k.d] || ds[list_position(ds, list_max(ds)) + 1:] ELSE ds END,
CASE WHEN k.d < list_max(ds) THEN ls[1:list_position(ds, list_max(ds)) - 1] || [k.label] || ls[list_position(ds, list_max(ds)) + 1:] ELSE ls END FROM s JOIN k ON k.qid = s.qid AND k.i = s.i + 1)"""


@query(f"{SLOTS} SELECT qid, CAST(list_sum(arg_max(ls, i)) AS BIGINT) AS fraud_count FROM s GROUP BY qid")
def topk_slot_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with slots filled in scan order, by distances in single precision."""
    refs, seeds, assigned = emb_index(spark, sf_dir)
    queries = emb_queries(refs)
    found = search.nearest_by_cell(search.probes(queries, seeds, DIMS, 2), assigned, DIMS, metric="f32", leave_out_self=True, ties="slot")
    return search.fraud_counts(queries, found, ties="slot")


@query()
def mllib_kmeans_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = embedding_refs(spark, sf_dir)
    centroids = train.mllib_centroids(refs, K, DIMS, 10, 7)
    return search.two_pass(emb_queries(refs), index.from_assigned(train.assign(refs, centroids, DIMS), centroids, EMB_CONFIG), leave_out_self=True)


@query(f"{EV_ALL} SELECT qid AS event_id, fraud_count, {DECISION} FROM two")
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index saved, loaded and validated before it is searched."""
    queries, built = ev_index(spark, sf_dir)
    path = work_dir(spark)
    index.save(built, path)
    loaded = index.load(spark, path, EV_CONFIG)
    return decide.decide(search.two_pass(queries, loaded, leave_out_self=True)).select(F.col("qid").alias("event_id"), "fraud_count", "fraud_score", "approved")


@query(f"{EV_ALL} SELECT qid AS event_id, 'ok' AS status, fraud_count, {DECISION} FROM two")
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scoring over a stream of payload files."""
    _, built, asked = ev_tables(event_payloads(spark, sf_dir))
    base = work_dir(spark)
    asked.write.parquet(f"{base}/in")
    score_stream(Engine(built), spark.readStream.schema(asked.schema).parquet(f"{base}/in"), "event_id", f"{base}/out", f"{base}/state", leave_out_self=True).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "status", "fraud_count", "fraud_score", "approved")


# --- sources, arguments, loops, life of an engine


def json_references(spark: SparkSession, sf_dir: str, compression: str | None = None) -> str:
    """Path of one JSON array of labelled vectors (the first 14 elements of the embeddings), in the order of vec_id."""
    record = F.to_json(F.struct(F.slice("embedding", 1, 14).alias("vector"), F.when(F.col("label") < 5, "fraud").otherwise("legit").alias("label"), F.struct("vec_id").alias("other")))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", record.alias("record"))
    least, most = rows.agg(F.min("vec_id"), F.max("vec_id")).first()
    line = F.concat(F.when(F.col("vec_id") == least, "[").otherwise(","), F.col("record"), F.when(F.col("vec_id") == most, "]").otherwise(""))
    path = work_dir(spark)
    # one file, because the array is one
    rows.repartition(1).sortWithinPartitions("vec_id").select(line.alias("value")).write.option("compression", compression or "none").text(path)
    return path


JSON_REFS = "WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS ref_id, CAST(CASE WHEN label < 5 THEN 1 ELSE 0 END AS INT) AS label, " + ", ".join(f"CAST(sign(CAST(embedding[{i + 1}] * 10000::FLOAT AS DOUBLE)) * floor(abs(CAST(embedding[{i + 1}] * 10000::FLOAT AS DOUBLE)) + 0.5) AS BIGINT) AS q{i}" for i in range(14)) + " FROM embeddings)"


@query(f"{JSON_REFS} SELECT ref_id, {_names('q', 14)}, label FROM v")
def references_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_references(spark, json_references(spark, sf_dir)).select("ref_id", *lane_names(14), "label")


@query(f"{JSON_REFS} SELECT ref_id, {_names('q', 14)}, label FROM v")
def references_json_gz_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_references(spark, json_references(spark, sf_dir, "gzip")).select("ref_id", *lane_names(14), "label")


@query(f"{JSON_REFS} SELECT CAST(sum(label) AS BIGINT) AS fraud_count, CAST(sum(1 - label) AS BIGINT) AS legit_count, count(*) AS n FROM v")
def references_json_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_counts(read_references(spark, json_references(spark, sf_dir))).select(*big("fraud_count", "legit_count", "n"))


#: Changes that break every record of a reference file.
WRONG_RECORDS = {
    "no vector": (r'"vector"', '"other"'), "no label": (r'"label"', '"mark"'), "too few": (r'"vector":\[[^,]*,', '"vector":['), "too many": (r'"vector":\[', '"vector":[0.5,'),
    "not a number": (r'"vector":\[[^,]*,', '"vector":["x",'), "other label": (r'"label":"[a-z]*"', '"label":"maybe"'), "none": (r"^\[", "["),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {'FALSE' if k == 'none' else 'TRUE'})" for k in WRONG_RECORDS) + ") t(change, refused)")
def reference_record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a file refused whose records are all changed so?"""
    good, out = json_references(spark, sf_dir), []
    for name, (pattern, text) in WRONG_RECORDS.items():
        path = work_dir(spark)
        spark.read.text(good, wholetext=True).select(F.regexp_replace("value", pattern, text).alias("value")).write.text(path)
        try:
            read_references(spark, path).write.format("noop").mode("overwrite").save()
            out.append((name, False))
        except Exception:
            out.append((name, True))
    return spark.createDataFrame(out, "change string, refused boolean")


ARGUMENTS = [(100, 16, 100), (0, 1, 1), (5, 6, 10), (10, 4, 3), (10, 0, 5), (5000, 4097, 5000), (5000, 4096, 4096)]


@query("SELECT n, k, sample, n > 0 AND k BETWEEN 1 AND least(n, 4096) AND sample >= k AS accepted FROM (VALUES " + ", ".join(map(str, ARGUMENTS)) + ") t(n, k, sample)")
def training_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    def accepted(n: int, k: int, sample: int) -> bool:
        try:
            train.check_arguments(n, k, sample)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(*a, accepted(*a)) for a in ARGUMENTS], "n int, k int, sample int, accepted boolean")


@query(f"SELECT CAST({K} AS BIGINT) AS seeds, CAST({K} AS BIGINT) AS distinct_seeds, CAST({K} AS BIGINT) AS of_references")
def plus_plus_seeds_are_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeds of k-means++: as many as asked for, all different, all of them rows of the reference set."""
    refs = embedding_refs(spark, sf_dir)
    seeds = train.plus_plus_seeds(refs, K, DIMS, 400, 7).select(F.array(*lane_names(DIMS, "c")).alias("lanes"), "cell")
    rows = refs.select(F.array(*lane_names(DIMS)).alias("lanes")).distinct()
    return seeds.join(rows.withColumn("known", F.lit(1)), "lanes", "left").agg(F.count(F.lit(1)).alias("seeds"), F.countDistinct("lanes").alias("distinct_seeds"), F.count("known").alias("of_references"))


ROUNDS = 4


def _rounds(n: int) -> str:
    parts = [EMB_INDEX, _updated(DIMS, "u1")]
    for i in range(1, n):
        parts += [_assigned("e", DIMS, f"a{i}", f"u{i}"), _updated(DIMS, f"u{i + 1}", f"a{i}", f"u{i}")]
    return ", ".join(parts)


@query(f"{_rounds(ROUNDS)} SELECT CAST(cell AS BIGINT) AS cell, {_names('c', DIMS)} FROM u{ROUNDS}")
def lloyd_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop itself, with its stop: where nothing changes any more, further rounds change nothing."""
    refs, seeds, _ = emb_index(spark, sf_dir)
    return train.lloyd(refs, seeds, DIMS, ROUNDS).select(*big("cell"), *lane_names(DIMS, "c"))


@query("SELECT * FROM (VALUES ('missing', FALSE, 'none'), ('fallback', TRUE, 'resources/index'), ('own', TRUE, 'index')) t(state, found, place)")
def index_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an index is looked for: at its path, and only if nothing is there below the fallback folder."""
    base, out = work_dir(spark), []
    refs, seeds, assigned = emb_index(spark, sf_dir)
    built = index.from_assigned(staged(assigned), seeds, EMB_CONFIG)
    for state, target in (("missing", None), ("fallback", f"{base}/resources/index"), ("own", f"{base}/index")):
        if target:
            index.save(built, target)
        try:
            out.append((state, True, index.resolve(spark, f"{base}/index", f"{base}/resources/index").removeprefix(f"{base}/")))
        except FileNotFoundError:
            out.append((state, False, "none"))
    return spark.createDataFrame(out, "state string, found boolean, place string")


@query("SELECT * FROM (VALUES (0, 'new', FALSE, 503, 0), (1, 'loaded', TRUE, 200, 16), (2, 'loaded again', TRUE, 200, 3), (3, 'closed', FALSE, 503, 0)) t(step, state, ready, status, warmed)")
def engine_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine before, with and after an index: readiness, the answer of the route, payloads scored by warm-up."""
    _, built = ev_index(spark, sf_dir)
    path, out = work_dir(spark), []
    index.save(built, path)

    def note(state: str, engine: Engine) -> None:
        out.append((len(out), state, engine.ready(), decide.route("GET", "/ready", engine.ready())[0], engine.warm_up(spark)))

    note("new", Engine())
    engine = Engine.load(spark, path, EV_CONFIG)
    note("loaded", engine)
    engine.close()
    with Engine.load(spark, path, EngineConfig.from_env({"WARMUP_ROUNDS": "3.9"}, dims=14, k=K, nprobe_fast=2, nprobe_full=4)) as again:
        note("loaded again", again)
    note("closed", again)
    return spark.createDataFrame(out, "step int, state string, ready boolean, status int, warmed int")


SETTINGS = ["", "0", "5", "3.9", "-1", "many", "inf", "1e2"]


@query("SELECT text, rounds FROM (VALUES ('', 16), ('0', 0), ('5', 5), ('3.9', 3), ('-1', 16), ('many', 16), ('inf', 16), ('1e2', 100)) t(text, rounds)")
def environment_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x, EngineConfig.from_env({"WARMUP_ROUNDS": x}).warmup_rounds) for x in SETTINGS], "text string, rounds int")


ROUTES = [("GET", "/ready"), ("GET", "/ready?probe=1"), ("POST", "/ready"), ("POST", "/fraud-score"), ("GET", "/fraud-score"), ("GET", "/other")]


@query("SELECT * FROM (VALUES ('GET', '/ready', 200, ''), ('GET', '/ready?probe=1', 200, ''), ('POST', '/ready', 405, 'GET'), ('POST', '/fraud-score', 0, ''), ('GET', '/fraud-score', 405, 'POST'), ('GET', '/other', 404, '')) t(method, url, status, allow)")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(m, u, *decide.route(m, u, True)[:2]) for m, u in ROUTES]
    return spark.createDataFrame([(m, u, status, headers.get("Allow", "")) for m, u, status, headers in found], "method string, url string, status int, allow string")
