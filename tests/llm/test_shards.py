import hashlib
import math
import random
from collections import Counter

import pytest

from kassa.llm import shards as sh


def brute_shard(key, weights):
    text = "null" if key is None else f"={key}"

    def cost(s):
        u = (int(hashlib.md5(f"{text}@{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        return -math.log(u) / weights[s]
    return min(weights, key=cost)


def assigned(spark, keys, shards):
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    return {r.k: r.shard for r in sh.with_shards(df, "k", shards).collect()}


def test_equals_brute_force_and_follows_weights(spark):
    keys = [f"rec-{i}" for i in range(4000)] + ["", "null", None]
    weights = {"a": 1.0, "b": 2.0, "c": 5.0, "off": 0.0}
    got = assigned(spark, keys, weights)
    used = {s: w for s, w in weights.items() if w}
    assert got == {k: brute_shard(k, used) for k in keys}
    share = Counter(got.values())
    for s, w in used.items():
        assert abs(share[s] / len(keys) - w / 8) < 0.03


def test_few_rows_move(spark):
    keys = [f"{i}" for i in range(5000)]
    before, after = assigned(spark, keys, 8), assigned(spark, keys, 9)
    moved = [k for k in keys if before[k] != after[k]]
    assert {after[k] for k in moved} == {8} and abs(len(moved) / len(keys) - 1 / 9) < 0.02
    # Without shard 3 only its own rows find another place.
    without = assigned(spark, keys, [s for s in range(8) if s != 3])
    assert all(without[k] == before[k] for k in keys if before[k] != 3)
    # A heavier shard only gains.
    heavier = assigned(spark, keys, {s: 3.0 if s == 2 else 1.0 for s in range(8)})
    assert {heavier[k] for k in keys if heavier[k] != before[k]} == {2}


def test_bad_shards():
    for bad in ([], {"a": 0}, {"a": -1, "b": 1}, {1: 1.0, "1": 1.0}):
        with pytest.raises(ValueError):
            sh.shard_weights(bad)


@pytest.mark.parametrize("cell_rows", [3, 40, 10_000])
def test_slots_are_gapless_and_do_not_depend_on_cells_or_partitions(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(sh, "RUN", 7)
    rng = random.Random(1)
    rows = [(rng.randrange(60), rng.randrange(3)) for _ in range(150)]
    rows += [(7, 1)] * 120 + [(None, None)] * 15               # hot copies and null keys
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, slot int").withColumnRenamed("slot", "x")
    df = sh.with_shards(df.repartition(5), "k", 4)
    got = sorted(((r.shard, r.slot, -1 if r.k is None else r.k, -1 if r.x is None else r.x)
                  for r in sh.with_slots(df, "k", cell_rows=cell_rows).collect()))
    assert Counter((k, x) for _, _, k, x in got) == Counter((-1 if k is None else k, -1 if x is None else x)
                                                            for k, x in rows)
    text = lambda k: "null" if k is None else f"={k}"
    digest = lambda k: hashlib.md5((text(k) + "#").encode()).hexdigest()
    weights = {s: 1.0 for s in range(4)}
    want = []
    for s in range(4):
        own = sorted((digest(k), -1 if k is None else k, -1 if x is None else x)
                     for k, x in rows if brute_shard(k, weights) == s)
        want += [(s, i, k, x) for i, (_, k, x) in enumerate(own)]
    assert got == sorted(want)


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], "k string, shard string, slot string")
    out = sh.with_slots(sh.with_shards(none, "k"), "k")
    assert out.columns == ["k", "shard", "slot"] and out.count() == 0


def test_written_shards_hold_whole_rows(spark, tmp_path):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('x', int(id % 7)) AS text")
    path = str(tmp_path / "shards")
    sh.write_shards(docs, path, "doc_id", 4, rows_per_file=20)
    back = spark.read.parquet(path)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())
    want = {r.doc_id: r.shard for r in sh.with_shards(docs, "doc_id", 4).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == want
    assert back.inputFiles() and spark.read.parquet(back.inputFiles()[0]).count() <= 20
