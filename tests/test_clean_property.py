"""Cleaning + enrichment on random dirty rows, against a brute-force Python
version of the same rules."""

from __future__ import annotations

import datetime as dt
import math
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kassa.config import DEFAULT
from kassa.plans.stages import enriched
from kassa.schema import RAW_COLUMNS, RAW_SCHEMA

VALID = st.tuples(
    st.integers(1, 12),                                          # transaction_id (collides)
    st.integers(1000, 1005),                                     # customer_id
    st.integers(100, 105),                                       # product_id
    st.sampled_from(["Lamp", "Mug"]),                            # product_name
    st.sampled_from(["Books", "Toys"]),                          # category
    st.integers(1, 200_000).map(lambda c: c / 100),              # price
    st.integers(1, 10),                                          # quantity
    st.integers(0, 40).map(lambda c: c / 100),                   # discount
    st.sampled_from(["upi", "cod"]),                             # payment_method
    st.sampled_from(["completed", "cancelled", "refunded"]),     # status
    st.sampled_from(["North", "South"]),                         # region
    st.sampled_from(["mobile", "desktop"]),                      # device_type
    st.datetimes(min_value=dt.datetime(2022, 1, 1), max_value=dt.datetime(2024, 12, 30))
    .map(lambda d: d.replace(microsecond=0).strftime("%Y-%m-%d %H:%M:%S")
         + ("" if d.microsecond % 2 else ".5")),                 # timestamp
    st.booleans(),                                               # is_duplicate_flag
)
# Dirt, by column position: each row gets at most one of these.
BAD = {0: [None], 1: [None], 3: [None, "None", "NA", ""], 4: [None, "n/a"],
       5: [None, float("nan"), float("inf"), -3.0, 0.0], 6: [None, 0, -1],
       7: [None, float("nan"), -0.2, 1.5], 8: [None, "NULL"], 9: [None], 10: [None],
       12: [None, "bad", "2024-01-01T10:00:00", "2024-02-30 00:00:00"]}
CHOICES = [(i, v) for i, vs in BAD.items() for v in vs]


def _corrupt(row, choice):
    if choice is None:
        return row
    i, value = choice
    return row[:i] + (value,) + row[i + 1:]


ROW = st.builds(_corrupt, VALID, st.one_of(st.none(), st.sampled_from(CHOICES)))

NA = set(DEFAULT.na_tokens)
STRINGS = {"product_name", "category", "payment_method", "status", "region", "device_type"}
MICRO = Decimal("0.000001")


def _parse(ts):
    if ts is None or ts in NA:
        return None
    head = ts[:19]
    try:
        value = dt.datetime.strptime(head, "%Y-%m-%d %H:%M:%S")
    except ValueError:
        return None
    return value if len(head) == 19 and head[10] == " " else None


def _key(r):
    """Order inside a key: time (nulls first), then every other column."""
    def part(v):
        if v is None:
            return (0, 0)
        if isinstance(v, float) and math.isnan(v):
            return (1, (2, 0))  # NaN sorts above every number in Spark
        return (1, (1, v) if isinstance(v, (int, float)) and not isinstance(v, bool) else (1, v))
    others = [c for c in RAW_COLUMNS if c not in ("transaction_id", "timestamp")]
    return (part(r["timestamp"]), *[part(r[c]) for c in others])


def brute_force(rows):
    recs = []
    for row in rows:
        r = dict(zip(RAW_COLUMNS, row))
        for c in STRINGS:
            if r[c] in NA:
                r[c] = None
        r["timestamp"] = _parse(r["timestamp"])
        recs.append(r)
    recs = [r for r in recs if r["transaction_id"] is not None]
    first = {}
    for r in sorted(recs, key=_key):
        first.setdefault(r["transaction_id"], r)
    out = []
    for r in first.values():
        crit = [r[c] for c in DEFAULT.critical]
        if any(v is None or (isinstance(v, float) and math.isnan(v)) for v in crit):
            continue
        if r["product_name"] is None:
            r["product_name"] = "Unknown Product"
        if r["discount"] is None or math.isnan(r["discount"]):
            r["discount"] = 0.0
        if not (0 < r["price"] < math.inf and r["quantity"] > 0):
            continue
        r["discount"] = min(max(r["discount"], 0.0), 1.0)
        price = Decimal(repr(r["price"])).quantize(MICRO, rounding=ROUND_HALF_UP)
        gross = price * r["quantity"]
        disc = (gross * Decimal(repr(r["discount"])).quantize(MICRO)).quantize(
            MICRO, rounding=ROUND_HALF_UP)
        r["net_revenue"] = (gross - disc).quantize(MICRO)
        out.append((r["transaction_id"], r["product_name"], r["discount"], r["net_revenue"],
                    r["timestamp"]))
    return sorted(out)


@settings(max_examples=20, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(rows=st.lists(ROW, min_size=1, max_size=40))
def test_clean_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, RAW_SCHEMA)
    got = sorted(tuple(r) for r in enriched(df, DEFAULT).select(
        "transaction_id", "product_name", "discount", "net_revenue", "timestamp").collect())
    assert got == brute_force(rows)
