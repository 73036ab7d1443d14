import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from kassa.llm import repeats as rp

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(texts, window=35):
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i:i + window])] > 1
                for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def run(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS bucket")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rp.kept_words(docs.repartition(3), **options).collect()}
    return [got[i] for i in range(len(texts))]


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(200)}" for _ in range(n)]
    passages = [fresh(n) for n in (34, 35, 36, 60, 200)]
    out = [None, "", " \n", "w " * 34, "w " * 35, "w " * 36, "a b " * 30, "é " + "\x0b ".join(fresh(50))]
    for _ in range(60):
        text = fresh(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "edit"
            text += p + fresh(rng.randrange(0, 20))
        out.append("  ".join(text) + "\n")
    return out + [out[-1], " ".join(passages[4]) * 1, "W " * 35]


@pytest.mark.parametrize("options", [{}, {"heavy_places": 1, "bucket_bytes": 500}, {"window": 41}])
def test_against_brute_force(spark, options):
    texts = corpus(len(options))
    assert run(spark, texts, **options) == brute(texts, options.get("window", 35))


def test_sliding():
    x = np.random.default_rng(0).integers(0, 99, 50)
    for width in (1, 2, 3, 7, 24, 50):
        got = rp._sliding(x, width, np.minimum)
        assert all(got[i] == x[i:i + width].min() for i in range(50))


def test_rows_without_or_with_equal_ids_and_empty_table(spark):
    text = " ".join(f"x{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text), (7, text), (7, "a b"), (7, "a b")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in rp.kept_words(docs).collect()), key=str)
    assert got == [(7, 2, 0), (7, 2, 0), (7, 40, 40), (None, 40, 40)]
    assert rp.kept_words(docs.limit(0)).count() == 0


def test_whole_table(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rp.op6_substring_dedup(spark, sf_small).collect()}
    want = [(n, k, hashlib.sha256(t.encode()).hexdigest()) for n, k, t in brute([r.text for r in rows])]
    assert [got[r.doc_id] for r in rows] == want and any(k for _, k, _ in want)
