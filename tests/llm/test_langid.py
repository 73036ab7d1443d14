import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kassa.llm import langid as li


def toy_net(langs=("aa", "bb")):
    rng = np.random.default_rng(0)
    x = rng.integers(97, 105, (600, li.WINDOW)).astype(np.uint8)
    y = np.arange(600) % len(langs)
    for i in range(600):
        word = b"zqx" if y[i] else b"wvy"
        for p in rng.integers(0, li.WINDOW - 3, 5):
            x[i, p:p + 3] = np.frombuffer(word, np.uint8)
    return li.fit_windows(x, y, list(langs)), x, y


def test_learns_and_tables_equal_direct_convolution():
    net, x, y = toy_net()
    logs = net.log_probs(x, net.tables())
    assert (logs.argmax(1) == y).mean() > 0.98
    pooled = []
    for w, k, b in zip(li.WIDTHS, net.filters, net.biases):
        cols = np.lib.stride_tricks.sliding_window_view(x[:20], w, axis=1)
        seen = net.embed[cols].reshape(20, -1, w * li.EMBED)
        pooled.append(np.maximum((seen @ k).max(1) + b, 0))
    direct = li._log_softmax(np.concatenate(pooled, 1) @ net.out + net.out_bias)
    assert np.allclose(direct, logs[:20], atol=1e-3)


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(2)
    net = li._fresh(["a", "b", "c"], rng)
    x, y = rng.integers(0, 256, (6, li.WINDOW)).astype(np.uint8), rng.integers(0, 3, 6)
    params = [net.embed, *net.filters, *net.biases, net.out, net.out_bias]
    for i, p in enumerate(params):
        params[i] = p.astype(np.float64)
    net = li.ByteCnn(net.langs, params[0], params[1:4], params[4:7], params[7], params[8])
    loss = lambda: -net_logs(net, x)[np.arange(6), y].mean()

    def net_logs(n, windows):
        pooled = []
        for w, k, b in zip(li.WIDTHS, n.filters, n.biases):
            cols = np.lib.stride_tricks.sliding_window_view(windows, w, axis=1)
            pooled.append(np.maximum((n.embed[cols].reshape(len(windows), -1, w * li.EMBED) @ k).max(1) + b, 0))
        return li._log_softmax(np.concatenate(pooled, 1) @ n.out + n.out_bias)

    grads = li._gradients(net, x, y)
    for p, g in zip(params, grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = loss()
        p[at] = old - 1e-5
        down = loss()
        p[at] = old
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=2e-2, abs=1e-5)


def test_edge_cases(spark):
    net, _, _ = toy_net()
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "wvy " * 40), (5, "ZQX " * 4000), (6, "é"), (7, "٣٤"),
            (8, "日本"), (None, "wvy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.predict(docs, net).collect()}
    assert got[1] == got[2] == got[3] == got[7] == ("und", 0.0)
    assert got[4][0] == "aa" and got[5][0] == "bb"
    assert all(x in ("aa", "bb") for x in (got[6][0], got[8][0], got[None][0]))
    assert all(0 <= s <= 1 for _, s in got.values())
    assert li.predict(docs.limit(0), net).count() == 0


def test_nothing_or_one_language_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    net = li.train(docs)
    assert [tuple(r) for r in li.predict(docs.select("text"), net).select("lang_pred", "score").collect()] == \
        [("und", 0.0), ("und", 0.0)]
    one = spark.createDataFrame([(1, "some text", "en"), (1, "some text", "en")], docs.schema)
    assert {r.lang_pred for r in li.predict(one, li.train(one)).collect()} == {"en"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = li.op9_language_id(spark, sf).join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
