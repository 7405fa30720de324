"""Transaction payloads: JSON text to typed fields, with a validity flag and a reason.

Fields are read by name.  A payload is invalid as a whole if any field is missing or malformed; it is
never dropped.  Where JSON reading alone can't tell, the raw text decides: a last transaction may be
null but not absent, and an id must stand there in quotes, at whatever place of its object.

The JVM never compiles a method of more than 8000 bytes, and Spark makes one method of all neighbouring
projections.  A higher-order function keeps a projection out of that, so rules and fields have one each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_MERCHANTS, MAX_F32, MAX_U32 = 64, 3.4028234663852886e38, 4294967295
MAX_INSTALLMENTS, MAX_TX_COUNT = 12, 20
_num, _str = T.DoubleType(), T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


WIRE = _struct(
    id=_str,
    transaction=_struct(amount=_num, installments=_num, requested_at=_str),
    customer=_struct(avg_amount=_num, tx_count_24h=_num, known_merchants=T.ArrayType(_str)),
    merchant=_struct(id=_str, mcc=_str, avg_amount=_num),
    terminal=_struct(is_online=T.BooleanType(), card_present=T.BooleanType(), km_from_home=_num),
    last_transaction=_struct(timestamp=_str, km_from_current=_num),
)
WS = r"[ \t\r\n]*"
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
#: Guards on the raw text.
HAS_LAST = rf'"last_transaction"{WS}:{WS}(null|[{{])'
ID_KEY = rf'"id"{WS}:{WS}"'


def iso_time(s: Column) -> Column:
    """Timestamp of a strict UTC text, null for any other."""
    return F.when(s.rlike(ISO), F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def hour_of(ts: Column) -> Column:
    return F.hour(ts)


def monday_based_day(ts: Column) -> Column:
    return F.weekday(ts)


def minutes_between(now: Column, last: Column) -> Column:
    """Whole minutes from last to now, both cut to minutes; 0 if last is later."""
    minute = lambda t: F.floor(F.unix_seconds(t) / 60)
    return F.greatest(F.lit(0), minute(now) - minute(last)).cast("bigint")


def capped_count(x: Column, cap: int) -> Column:
    return F.least(F.floor(x), F.lit(cap)).cast("bigint")


def scan_mcc(text: Column) -> Column:
    """Leading digits of a category code; null without digits, saturating at 32 bits."""
    digits = F.regexp_extract(F.coalesce(text, F.lit("")), r"^[0-9]+", 0)
    return F.when(digits != "", F.least(F.coalesce(digits.try_cast("bigint"), F.lit(MAX_U32)), F.lit(MAX_U32)))


def quoted_id(raw: Column, value: Column) -> Column:
    """Is the id of this value quoted?  Of a text with escapes some quoted id will do."""
    squeezed, quoted = F.regexp_replace(raw, ID_KEY, '"id":"'), F.concat(F.lit('"id":"'), value, F.lit('"'))
    # not by "or": Spark evaluates what an "or" holds twice, here the pattern, ahead of it
    return F.when(raw.contains(quoted), True).otherwise(squeezed.contains(quoted) | (raw.contains("\\") & squeezed.contains('"id":"')))


def says_last(raw: Column) -> Column:
    """Is there a last transaction, an object or null?  The pattern is for texts with blanks."""
    return raw.contains('"last_transaction":{') | raw.contains('"last_transaction":null') | raw.rlike(HAS_LAST)


def is_unknown_merchant(known: Column, merchant: Column) -> Column:
    return ~F.coalesce(F.exists(known, lambda m: m == merchant), F.lit(False))


def parse_payload(df: DataFrame, value: str = "value") -> DataFrame:
    """df with the parsed fields, is_valid and error (the first field that is wrong)."""
    raw = F.col(value)
    p = df.withColumn("__p", F.from_json(raw, WIRE, {"allowNonNumericNumbers": "false", "allowNumericLeadingZeros": "true"}))
    at = lambda path: F.col(f"__p.{path}")
    number = lambda c: c.isNotNull() & (F.abs(c) <= MAX_F32)
    p = p.withColumns({"__now": iso_time(at("transaction.requested_at")), "__last": iso_time(at("last_transaction.timestamp"))})
    now, last = F.col("__now"), F.col("__last")
    has_last = at("last_transaction").isNotNull()
    mcc = scan_mcc(at("merchant.mcc"))
    known = at("customer.known_merchants")
    rules = [
        ("json", F.col("__p").isNotNull()),
        ("id", at("id").isNotNull() & quoted_id(raw, at("id"))),
        ("amount", number(at("transaction.amount"))),
        ("installments", number(at("transaction.installments")) & (at("transaction.installments") >= 0)),
        ("requested_at", now.isNotNull()),
        ("customer.avg_amount", number(at("customer.avg_amount"))),
        ("tx_count_24h", number(at("customer.tx_count_24h")) & (at("customer.tx_count_24h") >= 0)),
        ("known_merchants", known.isNotNull() & (F.size(known) <= MAX_MERCHANTS)),
        ("merchant.id", at("merchant.id").isNotNull() & quoted_id(raw, at("merchant.id"))),
        ("mcc", mcc.isNotNull()),
        ("merchant.avg_amount", number(at("merchant.avg_amount"))),
        ("is_online", at("terminal.is_online").isNotNull()),
        ("card_present", at("terminal.card_present").isNotNull()),
        ("km_from_home", number(at("terminal.km_from_home"))),
        ("last_transaction", says_last(raw)),
        ("last_transaction.timestamp", ~has_last | last.isNotNull()),
        ("km_from_current", ~has_last | number(at("last_transaction.km_from_current"))),
    ]
    error = F.get(F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]), F.isnotnull), 0)
    fields = {
        "id": at("id"),
        "amount": at("transaction.amount").cast("float"),
        "installments": capped_count(at("transaction.installments"), MAX_INSTALLMENTS),
        "requested_at": now,
        "customer_avg_amount": at("customer.avg_amount").cast("float"),
        "tx_count_24h": capped_count(at("customer.tx_count_24h"), MAX_TX_COUNT),
        "mcc": mcc,
        "merchant_avg_amount": at("merchant.avg_amount").cast("float"),
        "is_online": at("terminal.is_online"),
        "card_present": at("terminal.card_present"),
        "km_from_home": at("terminal.km_from_home").cast("float"),
        "is_unknown_merchant": is_unknown_merchant(known, at("merchant.id")),
        "has_last_tx": has_last,
        "minutes_since_last": F.when(has_last, minutes_between(now, last)).otherwise(0).cast("bigint"),
        "km_from_current": F.when(has_last, at("last_transaction.km_from_current").cast("float")).otherwise(F.lit(0).cast("float")),
    }
    out = p.withColumn("error", error).withColumn("is_valid", F.col("error").isNull())
    # casts of refused values never run
    safe = {k: F.when(F.col("is_valid"), v) for k, v in fields.items()}
    kept = [c for c in df.columns if c not in safe and c not in ("error", "is_valid")]
    return out.select(*kept, *[v.alias(k) for k, v in safe.items()], "is_valid", "error")
