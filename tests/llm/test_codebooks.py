import math
import random

import numpy as np
import pytest

from kassa.llm import codebooks as cb


def brute(rows, parts, entries, rounds, scale):
    """Plain Lloyd over Python integers: every part against every entry."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[x[p * width:(p + 1) * width] for p in range(parts)] for _, x in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(nearest(p, c[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(members[k]) for col in zip(*members[k])] if k in members else e
                        for k, e in enumerate(books[p])]
    out = []
    for (i, _), c in zip(kept, cut):
        best = [nearest(p, c[p]) for p in range(parts)]
        out.append((i, bytes(k for _, k in best), sum(d for d, _ in best)))
    return out, books


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS code", "1 AS error")
    got, books = cb.compress(df.repartition(3), **options)
    assert got.columns == ["vec_id", "code", "error"]
    return [(r.vec_id, bytes(r.code), r.error) for r in got.collect()], books


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[2])


@pytest.mark.parametrize("seed,grid", [(0, 0.0), (1, 0.25), (2, 0.5)])
def test_equals_plain_lloyd(spark, seed, grid):
    """A coarse grid makes many ties between entries and equal vectors."""
    rng = random.Random(seed)
    draw = lambda: round(rng.gauss(0, 1) / grid) * grid if grid else rng.gauss(0, 1)
    rows = [(i, [draw() for _ in range(12)]) for i in range(160)]
    rows += [(i, rows[3][1]) for i in range(200, 280)]           # a third are one vector
    rows += [(5, [draw() for _ in range(12)]), (None, rows[0][1]), (300, None), (301, []), (302, [1.0] * 11 + [None]),
             (303, [math.nan] * 12), (304, [math.inf] + [0.0] * 11), (305, [0.0] * 8)]
    options = dict(parts=4, entries=6, rounds=5, scale=16)
    got, books = run(spark, rows, **options)
    want, want_books = brute([r for r in rows if r[0] != 305], **options)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert books.tolist() == want_books


def test_fewer_vectors_than_entries(spark):
    rows = [(2, [0.5, -0.5]), (1, [0.5, 0.25])]
    got, books = run(spark, rows, parts=2)
    assert books.shape == (2, 2, 1)
    want, want_books = brute(rows, 2, 16, 6, 4096)
    assert sorted(got) == sorted(want) and books.tolist() == want_books


def test_nothing_to_code(spark):
    assert run(spark, [])[0] == []
    assert run(spark, [(1, None), (2, [None])])[0] == []


def test_refuses_what_it_cannot_hold(spark):
    with pytest.raises(Exception, match="no 8 equal parts"):
        run(spark, [(1, [0.0] * 9)])
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e9] * 8)])


def test_active_entries_are_a_full_search():
    """Stored distances against unmoved entries, scans against moved ones."""
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (400, 2))
    book = rng.integers(-3, 4, (9, 2))
    code, best = np.zeros(400, np.uint8), np.zeros(400, np.int64)
    cb.nearest(x, book, code, best, None)
    for _ in range(20):
        moved = rng.random(9) < 0.4
        book = np.where(moved[:, None], rng.integers(-3, 4, (9, 2)), book)
        cb.nearest(x, book, code, best, moved)
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
