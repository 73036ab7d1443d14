"""Exact distributed quantiles against brute force on small fixtures.

Small bucket counts force several refinement rounds, hot values and ties."""

from __future__ import annotations

import random
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kassa.operators.quantile import exact_quantiles, order_statistics


def _brute(values, p):
    xs = sorted(values)
    pos = Decimal(len(xs) - 1) * Decimal(str(p))
    lo = int(pos)
    hi = min(lo + 1, len(xs) - 1)
    return xs[lo] + (xs[hi] - xs[lo]) * (pos - lo)


@pytest.mark.parametrize("buckets", [2, 7, 64, 65_536])
def test_decimal_quantiles_match_brute_force(spark, buckets):
    rnd = random.Random(7)
    values = [Decimal(rnd.randint(-50_000, 2_000_000)) / 100 for _ in range(3000)]
    values += [Decimal("123.45")] * 1500  # a hot value: a third of all rows
    df = spark.createDataFrame([(v,) for v in values], "x decimal(18,6)")
    probs = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    got = exact_quantiles(df, "x", probs, buckets=buckets)
    for p in probs:
        assert got[p] == _brute(values, p), p


@pytest.mark.parametrize("buckets", [3, 1000])
def test_double_order_statistics(spark, buckets):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.exponential(150, 2000), -rng.exponential(5, 300),
                             np.zeros(400), [1e-300, 1e300]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    ranks = [0, 1, 500, 1234, len(values) - 1]
    n, got = order_statistics(df, "x", ranks, buckets=buckets)
    xs = np.sort(values)
    assert n == len(values)
    for r in ranks:
        assert got[r] == xs[r]


def test_nulls_and_nan_are_ignored(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    assert exact_quantiles(df, "x", [0.5])[0.5] == 2.0


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "x decimal(18,6)")
    assert exact_quantiles(empty, "x", [0.5]) == {0.5: None}
    one = spark.createDataFrame([(Decimal("4.2"),)], "x decimal(18,6)")
    assert exact_quantiles(one, "x", [0.0, 0.9]) == {0.0: Decimal("4.2"), 0.9: Decimal("4.2")}


def test_all_rows_equal(spark):
    df = spark.createDataFrame([(Decimal("7"),)] * 500, "x decimal(18,6)")
    assert exact_quantiles(df, "x", [0.25, 0.9], buckets=2) == {0.25: Decimal("7"),
                                                                0.9: Decimal("7")}


def test_rejects_bad_arguments(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError):
        exact_quantiles(df, "x", [1.5])
    with pytest.raises(ValueError):
        order_statistics(df, "x", [3])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(min_value=-10**9, max_value=10**9), min_size=1, max_size=300),
       p=st.floats(min_value=0.0, max_value=1.0), buckets=st.integers(min_value=2, max_value=50))
def test_quantiles_property(spark, values, p, buckets):
    decs = [Decimal(v) / 1000 for v in values]
    df = spark.createDataFrame([(d,) for d in decs], "x decimal(18,6)")
    p = round(p, 3)
    assert exact_quantiles(df, "x", [p], buckets=buckets)[p] == _brute(decs, p)
