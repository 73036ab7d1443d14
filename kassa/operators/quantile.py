"""Exact and approximate quantiles without funnelling the data into one task.

Spark's exact ``percentile`` merges a map of every distinct value into a
single task for a global quantile; that does not survive 100 TB. Here the
exact order statistics are found by histogram refinement:

1. one aggregate pass counts the rows, with ``count/min/max``, per
   logarithmic bucket ``sign(x) * floor(64 * log1p(|x|))``: monotone, needs
   no min/max up front, and has at most 2 * 64 * 710 buckets for any finite
   double, so the bucket table is bounded by construction;
2. a prefix sum over that table finds the bucket of every wanted rank;
3. each further round splits every open interval still holding more than
   ``buckets`` rows into ``buckets`` equal-width buckets (all intervals in one
   aggregate pass; partial aggregation map-side, so a hot value costs nothing
   extra), collects that bounded table and keeps the bucket of each rank;
4. once an interval holds at most ``buckets`` rows, those rows are read and
   the rank is picked directly; an interval too narrow to split (adjacent
   values, so fewer than ``buckets`` distinct ones) is counted by value.

The bucket function is monotone, so everything below the chosen bucket is
strictly smaller than its ``min`` and everything above strictly larger than
its ``max``: the next round filters on ``[min, max]`` and adds the rows below
to the running offset. The interval strictly shrinks every round, and each
round divides its width by ``buckets``. No task and no driver call ever holds
more than ``buckets`` rows per wanted rank.

Quantiles are linear interpolation between the order statistics at
``floor((n-1)p)`` and ``ceil((n-1)p)``, like ``quantile_cont``/``numpy``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BUCKETS = 65_536


def _values(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    cond = c.isNotNull()
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        cond = cond & ~F.isnan(c)
    return df.select(c.alias("x")).where(cond)


# Buckets per e-fold of |x| in the first pass: each first-pass bucket spans a
# relative width of e^(1/64) - 1 (about 1.6 %), and there are at most
# 2 * 64 * 710 of them for any finite double, however many rows there are.
LOG_BUCKETS_PER_EFOLD = 64


def _log_bucket(x):
    """Monotone bucket of a value that needs no min/max: sign * log1p(|x|)."""
    xd = x.cast("double")
    k = F.lit(float(LOG_BUCKETS_PER_EFOLD))
    return F.when(xd >= 0, F.floor(F.log1p(xd) * k)).otherwise(-F.floor(F.log1p(-xd) * k) - 1)


def _first_pass(values: DataFrame) -> list[tuple]:
    """(bucket, n, min, max) of the log buckets, sorted: one aggregate pass."""
    rows = (values.groupBy(_log_bucket(F.col("x")).alias("b"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            .collect())
    return sorted((r["b"], r["n"], r["lo"], r["hi"]) for r in rows)


def _in(lo, hi):
    return F.col("x").between(F.lit(lo), F.lit(hi))


def _any(intervals):
    cond = F.lit(False)
    for lo, hi in intervals:
        cond = cond | _in(lo, hi)
    return cond


def _width(lo, hi, buckets: int) -> float:
    """Bucket width, from the distance in the column's own type."""
    return float(hi - lo) / buckets


def _histograms(values: DataFrame, wide: list[tuple], buckets: int) -> dict[int, list]:
    """Equal-width bucket tables of several intervals in one aggregate pass.

    Each row is tagged with the interval it falls in (intervals are disjoint
    or equal), then grouped by (interval, bucket): partial aggregation
    map-side, at most ``buckets`` groups per interval, so the collected table
    is bounded by construction. Rows outside every interval leave first (the
    filter reaches the scan). Distances are taken in the column's own type.
    """
    x = F.col("x")
    tags = []
    for i, (lo, hi) in enumerate(wide):
        b = F.least(F.floor((x - F.lit(lo)).cast("double") / F.lit(_width(lo, hi, buckets))),
                    F.lit(buckets - 1))
        tags.append(F.when(_in(lo, hi), F.struct(F.lit(i).alias("t"), b.alias("b"))))
    tagged = (values.where(_any(wide)).select(F.explode(F.array(*tags)).alias("tb"), "x")
              .where(F.col("tb").isNotNull()))
    rows = (tagged.groupBy(F.col("tb.t").alias("t"), F.col("tb.b").alias("b"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            .collect())
    out: dict[int, list] = {i: [] for i in range(len(wide))}
    for r in rows:
        out[r["t"]].append((r["b"], r["n"], r["lo"], r["hi"]))
    for i in out:
        out[i].sort(key=lambda e: e[0])
    return out


def _assign(hist: list[tuple], below: int, ranks: list[int], nxt: dict) -> None:
    """Prefix sums over a sorted bucket table: the bucket holding each rank."""
    seen = below
    for _, cnt, blo, bhi in hist:
        hit = [r for r in ranks if seen <= r < seen + cnt]
        if hit:
            nxt.setdefault((blo, bhi), [cnt, seen, []])[2].extend(hit)
        seen += cnt


def _select(values: DataFrame, first: list[tuple], ranks: Sequence[int],
            buckets: int) -> dict[int, object]:
    n = sum(e[1] for e in first)
    wanted = sorted(set(int(r) for r in ranks))
    if any(r < 0 or r >= n for r in wanted):
        raise ValueError(f"ranks must lie in [0, {n})")
    found: dict[int, object] = {}
    # interval (lo, hi) -> [rows in it, rows below it, ranks it must resolve]
    open_: dict[tuple, list] = {}
    _assign(first, 0, wanted, open_)
    while open_:
        for (lo, hi), (_, _, rs) in list(open_.items()):
            if lo == hi:  # one distinct value left
                found.update({r: lo for r in rs})
                del open_[(lo, hi)]
        small = {k: v for k, v in open_.items() if v[0] <= buckets}
        # Too narrow to split: less than `buckets` steps of the type apart.
        narrow = [k for k in open_ if k not in small and not _width(*k, buckets) > 0]
        wide = [k for k in open_ if k not in small and k not in narrow]
        if narrow:
            rows = values.where(_any(narrow)).groupBy("x").count().collect()
            for lo, hi in narrow:
                _, seen, rs = open_[(lo, hi)]
                for value, n in sorted((r["x"], r["count"]) for r in rows if lo <= r["x"] <= hi):
                    found.update({r: value for r in rs if seen <= r < seen + n})
                    seen += n
        if small:
            # At most `buckets` rows left per interval: read them in one pass.
            xs = [r["x"] for r in values.where(_any(small)).collect()]
            for (lo, hi), (_, below, rs) in small.items():
                part = sorted(v for v in xs if lo <= v <= hi)
                found.update({r: part[r - below] for r in rs})
        nxt: dict[tuple, list] = {}
        if wide:
            hists = _histograms(values, wide, buckets)
            for i, key in enumerate(wide):
                _, below, rs = open_[key]
                _assign(hists[i], below, rs, nxt)
        open_ = nxt
    return found


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int],
                     buckets: int = DEFAULT_BUCKETS) -> tuple[int, dict[int, object]]:
    """Exact values at the given 0-based ranks of the sorted non-null column.

    Returns ``(n, {rank: value})``; values keep the column's type (Decimal for
    decimals).
    """
    if buckets < 2:
        raise ValueError("buckets must be at least 2")
    values = _values(df, column)
    first = _first_pass(values)
    return sum(e[1] for e in first), _select(values, first, ranks, buckets)


def _interpolate(lo, hi, frac: Decimal):
    if isinstance(lo, Decimal):
        return lo + (hi - lo) * frac
    return float(lo) + (float(hi) - float(lo)) * float(frac)


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float],
                    buckets: int = DEFAULT_BUCKETS, cache: bool = True) -> dict[float, object]:
    """Exact linear-interpolation quantiles; ``None`` per prob when empty.

    ``cache=False`` when ``df`` is already persisted by the caller."""
    if any(not 0.0 <= p <= 1.0 for p in probs):
        raise ValueError("quantile probabilities lie in [0, 1]")
    if buckets < 2:
        raise ValueError("buckets must be at least 2")
    # The passes below read only this one column: keep it (spilling to disk
    # as needed) so the lineage above runs once. Lost blocks are recomputed.
    values = _values(df, column)
    if cache:
        values = values.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = _first_pass(values)
        n = sum(e[1] for e in first)
        if n == 0:
            return {p: None for p in probs}
        plan = {}
        for p in probs:
            pos = Decimal(n - 1) * Decimal(str(p))
            lo_r = int(math.floor(pos))
            plan[p] = (lo_r, min(lo_r + 1, n - 1), pos - lo_r)
        ranks = [r for lo, hi, _ in plan.values() for r in (lo, hi)]
        vals = _select(values, first, ranks, buckets)
    finally:
        if cache:
            values.unpersist()
    return {p: _interpolate(vals[lo], vals[hi], frac) for p, (lo, hi, frac) in plan.items()}


def approx_quantiles(df: DataFrame, column: str, probs: Sequence[float],
                     relative_error: float) -> dict[float, object]:
    """Greenwald-Khanna sketch (``percentile_approx``): bounded memory per task."""
    accuracy = max(1, int(round(1.0 / relative_error)))
    row = _values(df, column).agg(
        F.percentile_approx("x", list(probs), accuracy).alias("q")).first()
    if row["q"] is None:
        return {p: None for p in probs}
    return dict(zip(probs, row["q"]))


def quantiles(df: DataFrame, column: str, probs: Sequence[float],
              relative_error: float | None = None,
              buckets: int = DEFAULT_BUCKETS, cache: bool = True) -> dict[float, object]:
    """Exact when ``relative_error`` is None, else approximate."""
    if relative_error is None:
        return exact_quantiles(df, column, probs, buckets, cache)
    return approx_quantiles(df, column, probs, relative_error)
