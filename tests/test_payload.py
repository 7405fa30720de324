import json

import pytest

from tallyvec.functions.payload import parse_payload
from tallyvec.operators.features import vectorize

GOOD = {
    "id": "purchase 17",
    "transaction": {"amount": 150.25, "installments": 4, "requested_at": "2025-08-19T06:45:10Z"},
    "customer": {"avg_amount": 600.5, "tx_count_24h": 5, "known_merchants": ["shop-a", "shop-b"]},
    "merchant": {"id": "shop-b", "mcc": "5812", "avg_amount": 76.0},
    "terminal": {"is_online": True, "card_present": False, "km_from_home": 8.3},
    "last_transaction": {"timestamp": "2025-08-18T22:05:50Z", "km_from_current": 42.5},
}


def changed(path, value):
    d = json.loads(json.dumps(GOOD))
    *head, last = path.split(".")
    at = d
    for p in head:
        at = at[p]
    at[last] = value
    return json.dumps(d, separators=(",", ":"))


BAD = {
    "empty": "", "no json": "nonsense", "unquoted id": changed("id", 7), "quoted amount": changed("transaction.amount", "1"), "amount beyond single precision": changed("transaction.amount", 1e39),
    "negative installments": changed("transaction.installments", -1), "no such day": changed("transaction.requested_at", "2026-02-29T00:00:00Z"),
    "fraction": changed("transaction.requested_at", "2026-02-28T00:00:00.5Z"), "unpadded": changed("transaction.requested_at", "2026-2-28T00:00:00Z"),
    "hour 24": changed("transaction.requested_at", "2026-02-28T24:00:00Z"), "second 60": changed("transaction.requested_at", "2026-02-28T23:00:60Z"),
    "no last transaction": json.dumps({k: v for k, v in GOOD.items() if k != "last_transaction"}), "last transaction a number": changed("last_transaction", 5),
    "65 merchants": changed("customer.known_merchants", [f"M-{i}" for i in range(65)]), "mcc without digits": changed("merchant.mcc", "abc"),
    "boolean as text": changed("terminal.is_online", "true"), "boolean as number": changed("terminal.card_present", 1), "unquoted merchant": changed("merchant.id", 5),
}
ODD = {
    "unquoted mcc": (changed("merchant.mcc", 5912), "mcc", 5912), "mcc with letters": (changed("merchant.mcc", "59A2"), "mcc", 59), "fractional installments": (changed("transaction.installments", 3.7), "installments", 3),
    "installments capped": (changed("transaction.installments", 99), "installments", 12), "tx count capped": (changed("customer.tx_count_24h", 500), "tx_count_24h", 20),
    "negative amount": (changed("transaction.amount", -5), "q0", 0), "no average": (changed("customer.avg_amount", 0), "q2", 10000),
    "last is later": (changed("last_transaction.timestamp", "2025-08-20T00:00:00Z"), "minutes_since_last", 0), "trailing bytes": (json.dumps(GOOD, separators=(",", ":")) + " x", "q1", 3333),
    "no last": (changed("last_transaction", None), "q5", -10000), "unknown merchant": (changed("merchant.id", "M-9"), "q11", 10000),
    "id last": (json.dumps(dict(reversed(GOOD.items()))), "q0", 150), "merchant's id last": (json.dumps(GOOD | {"merchant": dict(reversed(GOOD["merchant"].items()))}), "q11", 0),
    "blanks around": (json.dumps(GOOD, indent=1).replace('"id": ', '"id" :\t'), "q0", 150), "id with escapes": (changed("id", 'a"b\\c'), "q0", 150),
    "leading zeros": (changed("transaction.amount", 77777).replace("77777", "0077"), "q0", 77),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [("good", json.dumps(GOOD, separators=(",", ":")))] + list(BAD.items()) + [(k, v[0]) for k, v in ODD.items()] + [("null", None)]
    return {r["name"]: r for r in vectorize(parse_payload(spark.createDataFrame(rows, "name string, value string"))).collect()}


def test_good(parsed):
    r = parsed["good"]
    assert r["is_valid"] and [r[f"q{i}"] for i in range(14)] == [150, 3333, 250, 2609, 1667, 3611, 425, 83, 2500, 10000, 0, 0, 3000, 76]


@pytest.mark.parametrize("name", [*BAD, "null"])
def test_bad(parsed, name):
    r = parsed[name]
    assert not r["is_valid"] and r["error"] and r["q0"] is None


@pytest.mark.parametrize("name", list(ODD))
def test_odd(parsed, name):
    assert parsed[name]["is_valid"] and parsed[name][ODD[name][1]] == ODD[name][2]


def test_methods_are_small_enough_to_be_compiled(spark):
    """The JVM only interprets a method of more than 8000 bytes."""
    plan = vectorize(parse_payload(spark.createDataFrame([("x", "")], "name string, value string")))._jdf.queryExecution().executedPlan()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(plan)
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert sizes and max(sizes) <= 8000


def test_id_beside_another_quoted_one(spark):
    rows = [("quoted", '{"id" : "7"}'), ("other", '{"id":7,"merchant":{"id":"8"}}'), ("escaped", '{"id":"a\\\\b"}')]
    got = {r["name"]: r["error"] for r in parse_payload(spark.createDataFrame(rows, "name string, value string")).collect()}
    assert got == {"quoted": "amount", "other": "id", "escaped": "amount"}
