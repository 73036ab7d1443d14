"""Scalar column helpers. All are plain Catalyst expressions, so they stay
inside whole-stage codegen and are constant-folded where possible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassa.config import TIMESTAMP_FORMAT


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def na_to_null(col: str | Column, tokens: Sequence[str]) -> Column:
    """Missing-value tokens of a text column become null.

    For a column name the rule is built as one SQL expression (one call to the
    JVM instead of one per token); both forms plan to the same ``InSet``.
    """
    if isinstance(col, str):
        name = sql_name(col)
        listed = ", ".join(sql_string(t) for t in tokens)
        return F.expr(f"CASE WHEN {name} IN ({listed}) THEN NULL ELSE {name} END")
    return F.when(col.isin(list(tokens)), F.lit(None).cast("string")).otherwise(col)


# The shape of TIMESTAMP_FORMAT text; with the range checks of the cast to
# timestamp_ntz it accepts exactly what the formatter accepts (tested).
_SECOND_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"


def tolerant_timestamp(col: str | Column, fmt: str = TIMESTAMP_FORMAT) -> Column:
    """Text to ``timestamp_ntz``: the first 19 characters must match ``fmt``
    (so sub-second tails are cut), anything else is null.

    The validated text is cast to ``timestamp_ntz`` directly, so the result
    never depends on the session time zone. For the standard format the check
    is a shape match plus the cast's own range checks (cheaper than a
    formatter). Another fixed-width ``fmt`` is parsed by the formatter on the
    first ``len(fmt)`` characters and read as wall-clock time.
    """
    if fmt == TIMESTAMP_FORMAT:
        head = F.substring(_c(col), 1, 19)
        return F.when(head.rlike(_SECOND_TEXT), head).try_cast(T.TimestampNTZType())
    head = F.substring(_c(col), 1, len(fmt))
    return F.try_to_timestamp(head, F.lit(fmt)).cast(T.TimestampNTZType())


def is_missing(col: str, dtype: T.DataType) -> Column:
    """Null, or NaN for floating columns (NaN counts as a missing cell)."""
    return F.expr(missing_sql(col, dtype))


def missing_sql(col: str, dtype: T.DataType) -> str:
    name = sql_name(col)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return f"({name} IS NULL OR isnan({name}))"
    return f"{name} IS NULL"


def missing_cells(df_schema: T.StructType, columns: Sequence[str]) -> Column:
    """Number of missing cells over ``columns`` (an aggregate, as one expression)."""
    types = {f.name: f.dataType for f in df_schema.fields}
    terms = " + ".join(f"count_if({missing_sql(c, types[c])})" for c in columns)
    return F.expr(f"CAST({terms or '0'} AS BIGINT)")


def clip(col: str | Column, low: float, high: float) -> Column:
    return F.least(F.greatest(_c(col), F.lit(low)), F.lit(high))


def round_money(col: str | Column, digits: int) -> Column:
    """Round an exact decimal (HALF_UP) and report it as double."""
    return F.round(_c(col), digits).cast("double")


def percent(part: str | Column, whole: str | Column, digits: int) -> Column:
    """``part / max(whole, 1) * 100`` rounded HALF_UP on exact decimals."""
    num = _c(part).cast("decimal(20,0)") * F.lit(100)
    den = F.greatest(_c(whole), F.lit(1)).cast("decimal(20,0)")
    return F.round(num / den, digits).cast("double")


def banded(col: str | Column, edges: Sequence, labels: Sequence[str]) -> Column:
    """Left-closed bands ``[e0, e1) ... [e_last, inf)``; null or below the first
    edge gives null."""
    if len(labels) != len(edges):
        raise ValueError("one label per edge: the last band is open")
    c = _c(col)
    expr = F.when(c.isNull() | (c < F.lit(edges[0])), F.lit(None).cast("string"))
    for edge, label in zip(edges[1:], labels[:-1]):
        expr = expr.when(c < F.lit(edge), F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def day_of_week(col: str | Column, week_start: str = "sunday") -> Column:
    """Sunday=1..Saturday=7 (``sunday``) or Monday=0..Sunday=6 (``monday``)."""
    if week_start == "sunday":
        return F.dayofweek(_c(col))
    if week_start == "monday":
        return F.weekday(_c(col))
    raise ValueError(f"week_start must be 'sunday' or 'monday', not {week_start!r}")
