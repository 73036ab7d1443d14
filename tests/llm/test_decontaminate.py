import hashlib
import re

import pytest

from kassa.llm import decontaminate as dc

PATTERN = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window=13):
    windows = {}
    for name, text in items:
        ws = words(text)
        size = min(window, len(ws))
        for i in range(len(ws) - size + 1 if ws else 0):
            windows.setdefault(tuple(ws[i:i + size]), set()).add(name)
    out = []
    for text in texts:
        ws, hit, names = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(ws) - size + 1):
                found = windows.get(tuple(ws[i:i + size]))
                if found:
                    hit.update(range(i, i + size))
                    names |= found
        ids = sorted(str(x) for x in names if x is not None)
        out.append((len(ws), len(hit), len(ids),
                    hashlib.sha256(",".join(ids).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(ws)))
    return out


def run(spark, texts, items, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    from pyspark.sql import functions as F
    got = {r[0]: tuple(r[1:]) for r in dc.mark(docs, bench, **options).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256), "contaminated").collect()}
    return [got[i] for i in range(len(texts))]


ABC = " ".join(f"w{i}" for i in range(20))
CASES = [None, "", "...", ABC, ABC.upper() + " tail", "w0 w1 w2", "x " * 40 + ABC,
         " ".join(f"w{i}" for i in range(12)), "w3 w4 w3 w4 w3 w4", "é ü ÀB w0", ABC + " " + ABC,
         "short item", "a short\nITEM here", "one", "w5 " * 30]


@pytest.mark.parametrize("items", [
    [(0, ABC)], [(0, ABC), (10, "short item"), (2, "one")], [(1, "w3 w4 w3"), (2, None), (3, "")],
    [], [(7, ABC), (7, ABC), (None, "w0 w1")], [(5, "w5 " * 14), (6, " ".join(f"w{i}" for i in range(4, 19)))],
    [(1, "a b a b a"), (2, "b a"), (3, "w0 w1 w2"), (4, "w1 w2"), (5, "w2")]])
@pytest.mark.parametrize("block", [1, 1 << 20])
def test_against_brute_force(spark, items, block):
    assert run(spark, CASES, items, block_bytes=block) == brute(CASES, items)


def test_random_small_alphabet(spark):
    import random
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))) for i in range(12)]
    assert run(spark, texts, items, window=5) == brute(texts, items, 5)


def test_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, ABC, "keep")], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame([(3, ABC)], "item_id long, text string")
    assert dc.mark(docs, bench).first().n_hit == 20
    assert dc.remove_spans(docs, bench).count() == 0
    assert dc.mark(docs.limit(0), bench).count() == 0
    clean = spark.createDataFrame([(2, "x. " * 500 + ABC + " end!", "keep")], docs.schema)
    row = dc.remove_spans(clean, bench).first()
    assert row.text == "x. " * 500 + " end!" and row.n_hit == "keep"


def test_whole_table(spark, sf_small):
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
           for r in dc.op3_decontaminate(spark, sf_small).collect()}
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    want = brute([d.text for d in docs], items)
    assert [got[d.doc_id] for d in docs] == want and any(w[4] for w in want)
