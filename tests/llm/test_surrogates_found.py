"""What the detection finds in ordinary documents of the four languages."""

import re

import pytest

from kassa.llm import surrogates as sg

PHONES = ["+33 1 23 45 67 89", "01 23 45 67 89", "01.23.45.67.89", "0123456789", "+33 (0)1 23 45 67 89", "0033 1 23 45 67 89",
          "+49 30 1234567", "0171 2345678", "030/1234567", "(030) 1234567", "+49 (0)171 2345678", "0171-234 56 78", "0049 171 2345678",
          "+44 7700 900123", "07700 900123", "020 7946 0958", "+44 (0)20 7946 0958", "07700900123",
          "+34 612 34 56 78", "612 34 56 78", "91 123 45 67", "+34 912 345 678", "+1 (743) 555-3824", "743-555-3824", "+7 495 123-45-67"]
NO_PHONES = ["on 01.02.2024 10:30", "2024-05-12", "from 1990 to 2005", "1 234 567 units", "0.123456789", "version 3.2.1", "12:30:45",
             "page 612 of 900", "5 10 15 20 25"]


@pytest.mark.parametrize("number", PHONES)
def test_phone(number):
    for text in (number, f"Tel. {number}, 12 items", f"({number})", f"call {number}."):
        assert re.findall(sg.PATTERNS["phone"], text) == [number]


@pytest.mark.parametrize("text", NO_PHONES)
def test_no_phone(text):
    assert re.findall(sg.PATTERNS["phone"], text) == []


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n) for r in sg.replace_pii(docs, counts="n").collect()}
    return [got[i] for i in range(len(texts))]


def test_documents(spark):
    phones = " ; ".join(PHONES)
    rows = replaced(spark, [
        phones,
        "Write to jörg.müller@exämple.de, JÖRG.MÜLLER@EXÄMPLE.DE or иван@почта.рф.",
        "Mr John Smith came. Later Smith said that John, SMITH's friend, met Smithson.",
        "Smith and John are no names here, 5 o'clock.",
        "Herr Prof. Dr. Weber, Dr. Anna Weber, Doña Carmen Ruiz y don Pedro. Weber-Ruiz, Mrs O'Brien; O'Brien’s hat; Carmen.",
        "Frau Meier-Koch ging. Meier-Koch kam, Dr. Koch blieb.",
    ])
    text, n = rows[0]
    assert n == len(PHONES) and re.sub("[0-9]", "0", text) == re.sub("[0-9]", "0", phones)
    assert all(a != b for a, b in zip(text.split(" ; "), PHONES))
    text, n = rows[1]
    one, two, three = re.fullmatch(r"Write to (\S+), (\S+) or (\S+)\.", text).groups()
    assert n == 3 and two == one.upper() and not set("öüä") & set(one) and re.fullmatch(r"[а-я]{4}@[а-я]{5}\.рф", three) and three != "иван@почта.рф"
    text, n = rows[2]
    m = re.fullmatch(r"Mr (\w+) (\w+) came\. Later (\w+) said that (\w+), (\w+)'s friend, met Smithson\.", text)
    john, smith, again, john2, upper = m.groups()
    assert n == 4 and smith == again == upper.title() and upper.isupper() and john == john2 and not {john, smith} & {"John", "Smith"}
    assert rows[3] == ("Smith and John are no names here, 5 o'clock.", 0)
    text, n = rows[4]
    m = re.fullmatch(r"Herr Prof\. Dr\. (\w+), Dr\. (\w+) (\w+), Doña (\w+) (\w+) y don (\w+)\. (\w+)-(\w+), Mrs (\w+); (\w+)’s hat; (\w+)\.", text)
    weber, anna, weber2, carmen, ruiz, pedro, weber3, ruiz2, brien, brien2, carmen2 = m.groups()
    assert n == 8 and weber == weber2 == weber3 and ruiz == ruiz2 and brien == brien2 and carmen == carmen2
    assert anna.lower().endswith(tuple(sg.ENDINGS["given_n", "latin"])) and not {"Weber", "Anna", "Carmen", "Ruiz", "Pedro"} & set(m.groups())
    text, n = rows[5]
    m = re.fullmatch(r"Frau (\w+) ging\. (\w+) kam, Dr\. (\w+) blieb\.", text)
    assert n == 3 and m[1] == m[2] != m[3]
