import re
from collections import Counter

import numpy as np

from kassa.llm import quality as q

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    count = Counter(windows)
    cover = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(cover),
            len(ws) < 10 or 100 * len(cover) > 20 * len(ws))


TEXTS = [None, "", "   \n\t", "one", "a b c d e", "a b c d e a b c d e", "x " * 50,
         "line one\nline one\n\n \nline  one\nline one", "é|ü <b>#*$%&</b>\x0bnext\x0cword\r\nend",
         "a b \U0001f600 c", "w " * 4 + "\n" + "w " * 7, " lead and trail ",
         " ".join(f"w{i % 37}" for i in range(3000)), "p q r s t " * 3 + " ".join(f"u{i}" for i in range(100))]


def test_statistics_against_brute_force(spark, sf_small):
    more = [r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("text").collect()]
    texts = TEXTS + more
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = q.apply_rules(q.statistics(docs), []).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in rows}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (i, t)
    assert all(r.kept == (not r.base_failed) for r in rows)


def test_learns_planted_rule():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    bad = (x[:, 0] > 0.7) & (x[:, 2] <= 0.4)
    bad ^= rng.random(3000) < 0.01
    rules = q.learn(x, bad, ["a", "b", "c"])
    assert rules
    caught = np.zeros(3000, dtype=bool)
    for r in rules:
        caught |= q._covers(r.tests, x, ["a", "b", "c"])
    truth = (x[:, 0] > 0.7) & (x[:, 2] <= 0.4)
    assert (caught & truth).sum() > 0.9 * truth.sum()
    assert (caught & ~truth).sum() < 0.02 * len(x)


def test_nothing_to_learn_and_order_of_rules(spark):
    assert q.learn(np.empty((0, 2)), np.empty(0, bool), ["a", "b"]) == []
    assert q.learn(np.ones((50, 1)), np.ones(50, bool), ["a"]) == []
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l", 9)], "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    row = q.judge(docs, labels).first()
    assert (row.n_words, row.kept, row.base_failed) == (12, True, False)
    assert q.judge(docs.limit(0), labels).count() == 0
    rules = [q.Rule((("n_words", ">", 5.0),), 1.0, 9)]
    assert q.apply_rules(q.statistics(docs), rules).first().kept is False


def test_nulls_in_labels(spark):
    docs = spark.createDataFrame([(None, None), (2, "t " * 20), (2, "t " * 20)], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (2, None), (2, 0)], "doc_id long, quality int")
    assert q.judge(docs, labels).count() == 3


def test_labelled_quality(spark):
    from pyspark.sql import functions as F
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = q.op10_quality_rules(spark, sf).join(labels, "doc_id").where("not base_failed")
    r = judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {x.quality: x.k for x in r}
    assert kept[1] > 0.97 and kept[0] < 0.5
    assert docs.count() == q.op10_quality_rules(spark, sf).count()
