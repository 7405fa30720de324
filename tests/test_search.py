import gzip
import json
import random

import numpy as np
import pytest

from tallyvec import cli
from tallyvec.functions.expr import lane_names
from tallyvec.operators import decide, index, search, staging, train
from tallyvec.plans.config import EngineConfig
from tallyvec.plans.engine import WARM_UP, Engine
from tallyvec.sources.references import read_references

DIMS = 14


@pytest.fixture(scope="module")
def refs(spark):
    rng = random.Random(1)
    rows = [(i, *[rng.randrange(0, 4) for _ in range(DIMS)], rng.randrange(2)) for i in range(300)]
    return spark.createDataFrame(rows, "ref_id long, " + ", ".join(f"{n} long" for n in lane_names(DIMS)) + ", label int").cache()


@pytest.fixture(scope="module")
def built(refs):
    config = EngineConfig(k=8, nprobe_fast=2, nprobe_full=8, sample=300, iterations=4)
    return index.build(refs, config)


def queries(refs):
    return refs.withColumnRenamed("ref_id", "qid").drop("label")


def plain(refs):
    rows = [tuple(r) for r in refs.collect()]
    out = {}
    for q in rows:
        near = sorted((sum((a - b) ** 2 for a, b in zip(q[1:-1], r[1:-1], strict=True)), r[0], r[-1]) for r in rows if r[0] != q[0])
        out[q[0]] = near
    return out


def test_all_probes_are_brute_force(refs, built):
    full = search.candidates(search.probes(queries(refs), built.centroids, DIMS, 8), built.lists, DIMS, leave_out_self=True)
    got = {(r["qid"], r["rank"]): (r["d"], r["ref_id"]) for r in search.nearest(full).collect()}
    want = {(q, k + 1): near[k][:2] for q, near in plain(refs).items() for k in range(5)}
    assert got == want


@pytest.mark.parametrize("rows", [7, 40])
def test_large_cells_are_dealt_to_groups(refs, built, monkeypatch, rows):
    monkeypatch.setattr(search, "GROUP_ROWS", rows)
    probed = search.probes(queries(refs), built.centroids, DIMS, 8)
    want = {(q, k + 1): near[k][:2] for q, near in plain(refs).items() for k in range(5)}
    found = search.nearest_by_cell(probed, built.lists, DIMS, leave_out_self=True)
    assert {(r["qid"], r["rank"]): (r["d"], r["ref_id"]) for r in search.nearest(found).collect()} == want
    every = search.candidates(probed, built.lists, DIMS, leave_out_self=True)
    assert every.count() == 300 * 299 and {(r["qid"], r["rank"]): (r["d"], r["ref_id"]) for r in search.nearest(every).collect()} == want


@pytest.mark.parametrize(("span", "count"), [(3, 900), (4000, 900), (1, 700), (50, 4)])
def test_nearest_rows_are_those_of_all_pairs(span, count):
    rng = np.random.default_rng(span)
    r, q = rng.integers(-span, span + 1, (count, 6)).astype(float), rng.integers(-span, span + 1, (150, 6)).astype(float)
    lo = rng.integers(0, count, 150)
    hi = lo + rng.integers(0, 3, 150).clip(max=count - lo)
    for own in ([], [lo, hi]):
        x, y, d = search.nearest_rows(q, r, 5, *own)
        got = sorted(zip(x.tolist(), d.tolist(), y.tolist(), strict=True))
        far = ((q[:, None] - r) ** 2).sum(2).astype(int).tolist()
        want = [(i, *p) for i, row in enumerate(far) for p in sorted((v, j) for j, v in enumerate(row) if not own or not lo[i] <= j < hi[i])[:5]]
        assert got == want


def test_far_boxes_are_not_read(monkeypatch):
    rng, read, partition = np.random.default_rng(2), [], np.partition
    r, q = rng.integers(0, 10_001, (20_000, 3)).astype(float), rng.integers(0, 10_001, (1000, 3)).astype(float)
    monkeypatch.setattr(search.np, "partition", lambda d, *a, **k: read.append(d.size) or partition(d, *a, **k))
    search.nearest_rows(q, r, 5)
    assert 0 < sum(read) < len(r) * len(q) / 5


def test_farther_cells_give_no_row_beyond_the_limit(refs, built):
    """The nearest of the first cell bound the others: the counts stay, fewer rows come out."""
    probed = staging.staged(search.probes(queries(refs), built.centroids, DIMS, 8))
    every = search.nearest_by_cell(probed, built.lists, DIMS, leave_out_self=True).collect()
    turned = search.first_found(probed, built, True)
    rest = search.nearest_by_cell(turned.filter("probe > 1").drop("near"), built.lists, DIMS, leave_out_self=True).collect()
    first = turned.filter("probe = 1").selectExpr("qid", "probe", "inline(near)").collect()
    near = lambda rows, probe: {q: sorted((r["d"], r["ref_id"]) for r in rows if r["qid"] == q and r["probe"] <= probe)[:5] for q in range(300)}
    assert all(near(first + rest, p) == near(every, p) for p in (1, 2, 8))
    worst = {q: d[4][0] for q, d in near(every, 1).items() if len(d) == 5}
    assert len(first + rest) < len(every) and all(r["d"] <= worst.get(r["qid"], r["d"]) for r in rest)


def test_limits_leave_out_far_rows():
    rng = np.random.default_rng(5)
    r, q = rng.integers(0, 9, (700, DIMS)).astype(float), rng.integers(0, 9, (90, DIMS)).astype(float)
    d = ((q[:, None] - r[None]) ** 2).sum(2).astype(int)
    limit = np.where(np.arange(90) % 3 == 0, np.inf, np.sort(d, 1)[:, np.arange(90) % 7][np.arange(90), np.arange(90)])
    want = {(i, int(j)) for i in range(90) for j in np.argsort(d[i], kind="stable")[:5] if d[i, j] <= limit[i]}
    x, y, far = search.nearest_rows(q, r, 5, limit=limit)
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == want and len(x) == len(want) and (far == d[x, y]).all()


def test_slot_ties_of_dealt_cells(refs, built, monkeypatch):
    probed = search.probes(queries(refs), built.centroids, DIMS, 3)
    whole = search.slot_fold(search.candidates(probed, built.lists, DIMS, leave_out_self=True))
    monkeypatch.setattr(search, "GROUP_ROWS", 9)
    few = search.slot_fold(search.nearest_by_cell(probed, built.lists, DIMS, leave_out_self=True, ties="slot"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, few.collect()))


def test_nearest_cells_by_plain_distances():
    rng = np.random.default_rng(1)
    cells = train.Cells(np.arange(50), rng.integers(-3, 4, (50, 6)).astype(float))
    rows = rng.integers(-3, 4, (200, 6)).astype(float)
    for n in (1, 4, 50, 60):
        places, found = cells.nearest(rows, n)
        for r, p, d in zip(rows, places, found, strict=True):
            want = sorted((int(((r - c) ** 2).sum()), k) for k, c in enumerate(cells.lanes))[:n]
            assert list(zip(d.tolist(), p.tolist(), strict=True)) == want


def test_mllib_centroids(spark, refs):
    """Cells from another trainer: with every cell probed the counts are those of brute force."""
    config = EngineConfig(k=6, nprobe_fast=6, nprobe_full=6, sample=300)
    centroids = train.mllib_centroids(refs, 6, DIMS, 5, 7)
    other = index.from_assigned(train.assign(refs, centroids, DIMS), centroids, config)
    index.validate(other)
    exact = {q: sum(x[2] for x in near[:5]) for q, near in plain(refs).items()}
    assert {r["qid"]: r["fraud_count"] for r in search.two_pass(queries(refs), other, leave_out_self=True).collect()} == exact


def test_plan_has_one_probe_and_one_search(spark, refs, built):
    plan = search.two_pass(queries(refs), built)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CoGroup") <= 2 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_settled_rounds_stop(spark, refs):
    seeds = train.first_seeds(refs, 4, DIMS)
    once, more = (sorted(map(tuple, train.lloyd(refs, spark.createDataFrame(seeds.collect(), seeds.schema), DIMS, n).collect())) for n in (60, 80))
    assert once == more


def test_payloads_are_parsed_once(spark, built, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_dir", lambda _: f"file://{tmp_path}")
    rows = spark.createDataFrame([(k, text) for k, text in enumerate([*WARM_UP, "broken", None, "{}"])], "k long, value string")
    scored = Engine(built).score(rows, "k")
    assert "from_json" not in scored._jdf.queryExecution().optimizedPlan().toString()
    got = {r["k"]: (r["status"], r["fraud_count"], r["approved"]) for r in scored.collect()}
    assert got.pop(0)[0] == got.pop(1)[0] == "ok" and got == {k: ("parse_error", 0, True) for k in (2, 3, 4)}


def test_keys_of_any_kind_and_name(spark, built):
    rows = spark.createDataFrame([("a", "broken"), ("b", WARM_UP[0])], "id string, value string")
    got = {r["id"]: r["status"] for r in Engine(built).score(rows, "id").collect()}
    assert got == {"a": "parse_error", "b": "ok"}


def test_staged_tables_go_with_their_step(spark, built, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_dir", lambda _: f"file://{tmp_path}")
    left = lambda: list((tmp_path / "tallyvec").glob("*"))
    assert Engine(built).warm_up(spark) == 16 and not left()
    scored = Engine(built).score(spark.createDataFrame([(1, WARM_UP[0])], "k long, value string"), "k")
    assert scored.count() == 1 and len(left()) == 1


def test_command_line(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    data = [{"vector": [rng.random() for _ in range(14)], "label": rng.choice(["fraud", "legit"])} for _ in range(60)]
    (tmp_path / "refs.json").write_text(json.dumps(data))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "payloads.txt").write_text("\n".join([*WARM_UP, "broken"]) + "\n")
    at = f"file://{tmp_path}"
    cli.main(["build-index", f"{at}/refs.json", f"{at}/index", "--k", "0x8", "--sample", "60", "--iterations", "3"])
    cli.main(["score", f"{at}/index", f"{at}/in/payloads.txt", f"{at}/out"])
    cli.main(["stream", f"{at}/index", f"{at}/streamed", f"{at}/state", "--option", f"path={at}/in"])
    want = sorted(r["status"] for r in spark.read.parquet(f"{at}/out").collect())
    assert want == ["ok", "ok", "parse_error"] == sorted(r["status"] for r in spark.read.parquet(f"{at}/streamed").collect())
    with pytest.raises(SystemExit):
        cli.main(["build-index", f"{at}/refs.json"])


def test_second_pass_only_in_band(refs, built):
    rows = search.two_pass(queries(refs), built, leave_out_self=True).collect()
    exact = {q: sum(x[2] for x in near[:5]) for q, near in plain(refs).items()}
    assert len(rows) == 300
    for r in rows:
        assert r["fraud_count"] == (exact[r["qid"]] if r["fast_count"] in (2, 3) else r["fast_count"])


def test_missing_neighbours_are_legitimate(refs):
    few = refs.filter("ref_id < 4")
    found = search.brute_force(queries(refs), few, DIMS, leave_out_self=True)
    labels = {r["ref_id"]: r["label"] for r in few.collect()}
    got = {r["qid"]: r["fraud_count"] for r in search.fraud_counts(queries(refs), found).collect()}
    assert len(got) == 300 and all(n == sum(v for i, v in labels.items() if i != q) for q, n in got.items())


def test_slot_ties(refs):
    found = search.brute_force(queries(refs), refs, DIMS, leave_out_self=True, ties="slot")
    got = {r["qid"]: r["fraud_count"] for r in search.fraud_counts(queries(refs), found, ties="slot").collect()}
    for q, near in plain(refs).items():
        slots = [[1e30, 0] for _ in range(5)]
        for d, _, label in sorted(near, key=lambda x: x[1]):
            worst = max(s[0] for s in slots)
            if d < worst:
                slots[[s[0] for s in slots].index(worst)] = [d, label]
        assert got[q] == sum(s[1] for s in slots)


def test_save_load_validate(spark, built, tmp_path):
    path = f"file://{tmp_path}/index"
    index.save(built, path)
    index.save(built, path)
    index.save(built, path)  # the version before the present one stays for its readers
    assert len(list((tmp_path / "index").glob("v-*"))) == 2 and (tmp_path / "index" / "CURRENT").is_file()
    loaded = index.load(spark, path)
    assert loaded.lists.count() == 300 and Engine.load(spark, path).ready()
    assert not Engine.load(spark, f"file://{tmp_path}/none").ready()
    with pytest.raises(ValueError):
        index.validate(index.Index(built.config, built.centroids, built.lists.limit(10), built.stats, built.meta))


def test_not_ready_approves(spark):
    r = Engine().score(spark.createDataFrame([(1, "x")], "id long, value string"), "id").first()
    assert (r["status"], r["approved"], r["fraud_score"]) == ("not_ready", True, 0.0)


@pytest.mark.parametrize("suffix", ["json", "json.gz"])
def test_references(spark, tmp_path, suffix):
    data = [{"vector": [i / 10] * 14, "label": "fraud" if i % 2 else "legit", "other": {"a": 1}} for i in range(6)]
    path = tmp_path / f"refs.{suffix}"
    opener = gzip.open if suffix.endswith("gz") else open
    with opener(path, "wt") as f:
        json.dump(data, f)
    rows = read_references(spark, f"file://{path}").orderBy("ref_id").collect()
    assert [(r["q0"], r["label"]) for r in rows] == [(i * 1000, i % 2) for i in range(6)]


@pytest.mark.parametrize("record", [{"vector": [0.1] * 13, "label": "fraud"}, {"vector": [0.1] * 14, "label": "x"}, {"vector": [0.1] * 14}, {"label": "fraud"}])
def test_wrong_references(spark, tmp_path, record):
    (tmp_path / "r.json").write_text(json.dumps([record]))
    with pytest.raises(Exception, match="vector|label"):
        read_references(spark, f"file://{tmp_path}/r.json").collect()


def test_arguments():
    for n, k, sample in ((0, 1, 1), (5, 6, 10), (10, 4, 3), (10, 0, 5)):
        with pytest.raises(ValueError):
            train.check_arguments(n, k, sample)


def test_routes():
    assert decide.route("GET", "/ready?x=1", True) == (200, {}, "ok") and decide.route("GET", "/ready", False)[0] == 503
    assert decide.route("POST", "/ready", True) == (405, {"Allow": "GET"}, "") and decide.route("GET", "/x", True)[0] == 404
