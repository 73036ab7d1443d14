import random
import re

import numpy as np
import pytest

from kassa.llm import jaccard as j
from kassa.llm.components import connected_components

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingles(text):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return set()
    return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)}


def brute(rows, t=(3, 4)):
    sets = [shingles(x) for _, x in rows]
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            if t[1] * len(sets[a] & sets[b]) >= t[0] * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)), key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS z")
    return sorted((tuple(r) for r in j.components(docs.repartition(3), **options).collect()), key=str)


EDGE = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (9, "ONE  two"), (5, "a b c d"), (6, "a b c d e"),
        (7, "A b c d E"), (8, "a b c d e f"), (None, "a b c d e"), (11, "w " * 4000), (12, "W " * 30),
        (10, "x y"), (10, "a b c d e"), (13, "x Y"), (14, "Ä b c d e"), (15, "ä b c d e"), (16, "p q r s t u v"),
        (16, "p q r s t u v")]


def test_edge_cases(spark):
    assert run(spark, EDGE) == brute(EDGE)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice("pqrstu") + str(rng.randrange(50))
    return " ".join(out)


@pytest.mark.parametrize("seed", range(2))
def test_near_copies_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(j, "LEAST_HASHES", 1 + seed)          # few stars: the join must find the rest
    rng = random.Random(seed)
    rows, common = [], "this line is in very many documents of this table and more"
    for base in range(8):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([12, 40, 90, 160]))]
        for _ in range(rng.choice([2, 10, 22])):
            rows.append((len(rows) * 3, edited(rng, words, rng.randrange(0, 1 + len(words) // 18)) +
                         (" " + common if rng.random() < 0.5 else "")))
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_prefix_join_alone_is_exact():
    """Every pair that reaches the threshold comes out of the token join."""
    import pyarrow as pa
    rng, t = random.Random(4), (3, 4)
    sets = []
    for base in range(12):
        core = rng.sample(range(10 ** 6), rng.randrange(3, 60))
        for _ in range(6):
            keep = [x for x in core if rng.random() < 0.93]
            sets.append(set(keep) | set(rng.sample(range(10 ** 6), rng.randrange(0, 4))))
    hashed = [j.mix(np.array(sorted(s), dtype=np.uint64) + np.uint64(1)) for s in sets]
    tokens, docs = [], np.empty(len(sets), j._DOC)
    for i, h in enumerate(hashed):
        h = np.sort(h)
        k = j._prefix(len(h), t) if len(h) else 0
        docs[i] = (i, i, len(h))
        tokens += [(int(x) >> 32, (int(x) >> 16) & 0xFFFF, i, p) for p, x in enumerate(h[:k])]
    rows = np.array(tokens, dtype=j._TOKEN)
    blob = b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in j._TOKEN.names)
    table = pa.table({"rows": [len(rows)], "tokens": pa.array([blob], pa.binary()),
                      "docs": pa.array([docs.tobytes()], pa.binary())})
    for chunk in (5, 10 ** 6):
        found = {(min(a, b), max(a, b)) for p in j._join_tokens(table, t, chunk) for a, b, *_ in p.tolist()}
        want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))
                if sets[a] | sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
        assert want <= found and len(found) < len(sets) ** 2 / 4


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, x) for x in range(200, 260)] + [(1, 1), (None, 3)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    nodes = {x for a, b in edges if a != b and None not in (a, b) for x in (a, b)}
    assert got == {x: find(x) for x in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_per_component(spark):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (2, "other words here they are"), (2, "other words here they are"),
            (None, "a b c d e"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS component_id")
    kept = j.one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 4, None]
    assert j.one_per_component(docs.limit(0)).count() == 0


def test_whole_table(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in j.op7_jaccard_join(spark, sf_small).collect()), key=str)
    want = brute(rows)
    assert got == want and len({w[2] for w in want}) < len(rows)
