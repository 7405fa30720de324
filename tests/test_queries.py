import duckdb
import pytest

import __spark_entry__ as entry
from tallyvec.plans import queries
from tallyvec.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(frame):
    names = sorted(frame.columns)
    norm = lambda v: round(float(v), 9) if isinstance(v, (int, float, bool)) or hasattr(v, "dtype") else str(v)
    return names, sorted(str([norm(v) for v in r]) for r in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", ["payload_parse_invalid_fail_open", "feature_lanes_14", "lloyd_one_step", "block_offsets", "block_slots", "probe_top_n", "knn5_bruteforce", "ivf_two_pass", "stream_score"])
def test_oracle(spark, con, sf, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(con.execute(ORACLES[name]).df())


def test_every_event_is_a_reference(spark, con, sf):
    name = "score_against_all_events"
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(con.execute(ORACLES[name]).df())
    _, built = queries.ev_index(spark, sf)
    assert built.lists.count() == built.lists.select("ref_id").distinct().count() == con.execute("SELECT count(*) FROM events").fetchone()[0]


def test_trained_index_finds_the_neighbours(spark, con, sf):
    """Recall@5 of the registered search through index.build, by plain SQL, and the query that reports it."""
    found = {(r["qid"], r["ref_id"]) for r in QUERIES["trained_index_search"](spark, sf).collect()}
    exact = set(map(tuple, con.execute(ORACLES["knn5_bruteforce"]).df()[["qid", "ref_id"]].itertuples(index=False)))
    r = QUERIES["trained_index_recall"](spark, sf).first()
    assert (r["neighbours"], r["found"]) == (len(exact), len(found & exact)) and r["recall"] >= 0.9


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
