"""The tolerant timestamp parse: shape check + cast equals the formatter."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassa.config import TIMESTAMP_FORMAT
from kassa.functions.columns import tolerant_timestamp

EDGE = ["2024-01-01 10:00:00", "2024-02-29 00:00:00.123", "2023-02-29 00:00:00",
        "0000-01-01 00:00:00", "0001-01-01 00:00:00", "9999-12-31 23:59:59",
        "2024-13-01 00:00:00", "2024-00-10 00:00:00", "2024-01-00 00:00:00",
        "2024-01-32 00:00:00", "2024-04-31 00:00:00", "2024-01-01 24:00:00",
        "2024-01-01 23:60:00", "2024-01-01 23:59:60", "2024-01-01T10:00:00",
        "2024-1-01 10:00:00", " 2024-01-01 10:00:00", "2024-01-01 10:00:0",
        "2024-01-01 10:00:00Z", "+024-01-01 10:00:00", "-024-01-01 10:00:00",
        "2024/01/01 10:00:00", "", "None", None, "2024-01-01 10:0a:00",
        "２０２４-01-01 10:00:00", "2024-01-01  10:00:00",
        "2024-01-01 10:00:00.999999999", "bad"]


def test_shape_check_equals_formatter(spark):
    rnd = random.Random(11)
    near = []
    for _ in range(5000):
        y, mo, d = rnd.randint(0, 9999), rnd.randint(0, 13), rnd.randint(0, 32)
        h, mi, s = rnd.randint(0, 25), rnd.randint(0, 61), rnd.randint(0, 61)
        near.append(f"{y:04d}-{mo:02d}-{d:02d} {h:02d}:{mi:02d}:{s:02d}")
    noise = ["".join(rnd.choice("0123456789-: T.+/aZ") for _ in range(rnd.randint(15, 23)))
             for _ in range(5000)]
    df = spark.createDataFrame([(x,) for x in EDGE + near + noise], "s string")
    head = F.substring("s", 1, 19)
    formatter = F.when(F.try_to_timestamp(head, F.lit(TIMESTAMP_FORMAT)).isNotNull(), head) \
                 .try_cast(T.TimestampNTZType())
    out = df.select(tolerant_timestamp("s").alias("a"), formatter.alias("b"))
    assert out.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
    assert out.where(F.col("a").isNotNull()).count() > 1000


def test_other_formats_use_the_formatter(spark):
    df = spark.createDataFrame([("01/02/2024 10:00:00",), ("2024-01-02 10:00:00",)], "s string")
    got = [r[0] for r in df.select(tolerant_timestamp("s", "dd/MM/yyyy HH:mm:ss")).collect()]
    assert str(got[0]) == "2024-02-01 10:00:00" and got[1] is None
