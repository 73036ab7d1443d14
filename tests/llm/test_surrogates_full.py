"""Formats whose entities leave hardly a value free."""

import pytest

from kassa.llm import surrogates as sg


def made(spark, kind, canons):
    rows = sg.surrogates(spark.createDataFrame([(kind, c) for c in canons], "kind string, canon string")).collect()
    assert sorted(r.canon for r in rows) == sorted(canons)
    values = {r.surrogate for r in rows}
    assert len(values) == len(canons) and not values & set(canons)
    return {r.canon: r.surrogate for r in rows}


def test_every_one_letter_local_part(spark):
    mails = [f"{c}@{d}.com" for d in ("x", "hot", "mail5.example") for c in sg._LETTERS]
    table = made(spark, "email", mails)
    assert sum(len(v) > len(k) for k, v in table.items()) < len(mails) / 2


def test_formats_are_filled_by_rank(spark, monkeypatch):
    monkeypatch.setattr(sg, "MOST_ROUNDS", 1)
    made(spark, "phone", [f"{i:02d}" for i in range(50)])
    luhn = [f"{i}{(10 - (2 * i - 9 * (i > 4)) % 10) % 10}" for i in range(5)]
    table = made(spark, "card", luhn)
    doubled = lambda d: 2 * d - 9 * (d > 4)
    assert all((doubled(int(v[0])) + int(v[1])) % 10 == 0 for v in table.values())
    with pytest.raises(RuntimeError, match="phone entities"):
        made(spark, "phone", list("012345"))


def test_a_grown_address_keeps_its_case(spark):
    piece = spark.createDataFrame([("A@X.Com", "qk@z.com")], "p string, s string")
    from pyspark.sql import functions as F
    assert piece.select(sg._written(F.col("p"), F.lit("email"), F.col("s"))).first()[0] == "Qk@Z.Com"
