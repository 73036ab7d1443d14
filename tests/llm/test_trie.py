import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kassa.llm import trie as tr


def brute_nodes(seqs):
    """``seqs``: conv -> list of (token, bytes)."""
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * p[-1][1] if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            named = f"{len(role.encode())}:{role}{text}".encode()
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(named).digest()[:16], role, text))
    for c in own:
        own[c] = [((role, text), len(text.encode())) for _, _, role, text in sorted(own[c])]
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def nodes(spark, rows):
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS pos", "2 AS n")
    turns, convs = tr.with_borrowed_heads(tr.numbered(tr.turn_digests(df.repartition(4))), heads,
                                          F.col("conv_id") - F.col("conv_id") % 5, 8)
    return sorted((tuple(r) for r in tr.prefix_trie(turns, convs).collect()), key=str)


def conversations(seed):
    """Small alphabets, copies, prefixes of each other, one long and one hot conversation."""
    rng = random.Random(seed)
    fresh = lambda n: [(rng.choice(["user", "assistant", None]), rng.choice(["", "é", "ab", None, "xyz"])) for _ in range(n)]
    bodies = [fresh(rng.randrange(1, 14)) for _ in range(12)]
    rows = []
    for c in range(90):
        body = list(rng.choice(bodies))[:rng.randrange(1, 15)] + (fresh(rng.randrange(0, 3)) if rng.random() < 0.5 else [])
        rows += [(c + 5 * (c > 70), t, *x) for t, x in enumerate(body)]
    for c in range(200, 260):                                   # a group of copies
        rows += [(c, t, *x) for t, x in enumerate(bodies[0] + bodies[1])]
    rows += [(300, t, "user", f"long {t % 7}") for t in range(20)] + [(305, t, "user", f"long {t % 7}") for t in range(19)]
    rows += [(400, None, "b", "null turn"), (400, 2, "a", "tie"), (400, 2, "b", "tie"), (400, 2, "a", "tie"),
             (None, 1, "user", "no conversation"), (403, 1, "user", "turnless or one"), (405, 0, None, None)]
    return rows


@pytest.mark.parametrize("seed,segment,fan,piece", [(0, 1024, 64, 1 << 14), (1, 6, 2, 9)])
def test_equals_brute_force(spark, monkeypatch, seed, segment, fan, piece):
    """Short segments make many levels; a small fan makes many joins of forests."""
    monkeypatch.setattr(tr, "SEGMENT", segment)
    monkeypatch.setattr(tr, "_PIECE", piece)
    monkeypatch.setattr(tr, "_RUN", 4)
    monkeypatch.setattr(tr.prefix_trie, "__defaults__", (fan,))
    rows = conversations(seed)
    assert nodes(spark, rows) == brute_nodes(rebuilt(rows))


def test_one_conversation_and_none(spark):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 1, "a", "b")]) == []
    rows = [(7, 0, "user", "alone")]
    assert nodes(spark, rows) == brute_nodes(rebuilt(rows))


def test_numbers_of_a_conversation_that_crosses_ranges(spark):
    """A third of all rows in one conversation, half of them equal."""
    rows = [(1, t // 2, "user", "same") for t in range(400)] + [(c, t, "user", str(t)) for c in range(2, 202) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = tr.numbered(tr.turn_digests(df)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.conv_id].append((r.pos, r.turn))
    assert Counter(len(v) for v in by.values()) == {400: 1, 4: 200}
    for v in by.values():
        v.sort()
        assert [p for p, _ in v] == list(range(1, len(v) + 1)) and [t for _, t in v] == sorted(t for _, t in v)


def test_a_contracted_forest_is_as_long_as_its_paths_are_deep():
    rng = random.Random(5)
    seqs = sorted({tuple(rng.randrange(3) for _ in range(rng.randrange(1, 9))) for _ in range(3000)})
    items = []
    for i, s in enumerate(seqs):
        x = {"depth": len(s), "weight": len(s), "m": 1, "mn": i, "leaves": 0, "saved": 0, "kids": 0, "ends": i, "gid": b"",
             "before": 0, "lcp": None, "lcp_weight": None}
        if items:
            n = next((k for k, (a, b) in enumerate(zip(seqs[i - 1], s)) if a != b), min(len(seqs[i - 1]), len(s)))
            x["lcp"] = x["lcp_weight"] = n
        items.append(x)
    rows, kept = tr._forest(items, 0, whole=False)
    assert len(items) > 1000 and len(kept) <= 2 * 9 and all(x["kind"] == "node" for x in rows)
