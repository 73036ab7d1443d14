"""Long secrets, and one text of many mentions and names."""

import re

import pytest

from kassa.llm import surrogates as sg


def replaced(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.n) for r in sg.replace_pii(docs, counts="n").orderBy("doc_id").collect()]


KEY = ("Ab3" * 400)[:1000]
JWT = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV"


@pytest.mark.parametrize("text,secret", [
    (f"token = {KEY}", KEY), (f"password: '{KEY[:300]}' now", KEY[:300]), (f"use sk-{KEY[:100]} here", KEY[:100]),
    (f"use sk-proj-{KEY[:40]}_{KEY[40:90]}", f"proj-{KEY[:40]}_{KEY[40:90]}"), (f"secret={JWT}", JWT),
    (f"Bearer {JWT}.", JWT), (f"key ghp_{KEY[:80]}", KEY[:80]), (f"AKIA{'Q7' * 12}", "Q7" * 12),
    (f"api_key: {KEY[:40]}==", KEY[:40])])
def test_a_secret_is_replaced_to_its_end(spark, text, secret):
    (out, n), = replaced(spark, text)
    assert n == 1 and len(out) == len(text) and not any(secret[i:i + 12] in out for i in range(0, len(secret) - 12, 6))
    kept = text.index(secret)
    assert out[:kept] == text[:kept] and out[kept + len(secret):] == text[kept + len(secret):]


def test_a_text_of_many_mentions(spark):
    """100,000 addresses in one text: rows, not copies of their list."""
    text = " ".join(f"user{i}@mail{i % 7}.example.com" for i in range(100_000))
    (out, n), = replaced(spark, text)
    found = out.split(" ")
    assert n == 100_000 and len(set(found)) == 100_000 and not set(found) & set(text.split(" "))


def test_many_names_that_come_again(spark):
    alphabet = "bcdfghjklmnpqrstvwxz"
    names = [f"{a.upper()}{b}o{c}{d}a" for a in alphabet for b in alphabet[:10] for c in alphabet[:10] for d in alphabet[:2]]
    text = " ".join(f"Mr {n} spoke." for n in names) + " Later " + " and ".join(names)
    (out, n), = replaced(spark, text)
    assert n == 2 * len(names)
    titled, later = out.split(" Later ")
    assert re.findall(r"Mr (\w+) spoke", titled) == later.split(" and ")
    assert not set(later.split(" and ")) & set(names)
