import base64
import hashlib
import random

import pytest

from kassa.llm import warc


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows, least=0):
    best = {}
    for i, _, html in rows:
        body = html or ""
        if len(body.encode()) >= least and i is not None:
            best[body] = max(best.get(body, i), i)
    out = []
    for i, _, html in rows:
        body = html or ""
        top = best.get(body)
        same = top is None or i == top or len(body.encode()) < least
        out.append((i, len(body.encode()), digest(html), "response" if same else "revisit",
                    None if same else top))
    return sorted(out, key=str)


ROWS = [(1, "http://a.com/x", "one"), (5, "http://b.com/", "one"), (3, "HTTP://WWW.A.com/X?b=2&a=1", "one"),
        (4, None, None), (6, "", ""), (7, "http://a.com/x", "ünï\r\n\r\nWARC/1.1\r\nWARC-Type: x"),
        (2, "http://a.com/x y\n", "two"), (9, "not a url", "x" * 70000), (9, "not a url", "x" * 70000),
        (None, "http://c.com", "one"), (None, "http://c.com:99/a", "alone"), (-8, "http://[bad", "\x00\n"),
        (10, "http://a.com/x", "trail\n"), (11, "http://a.com/x", "trail\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 4])
def test_round_trip(spark, tmp_path, least):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(4)
    path = str(tmp_path / "w")
    warc.write_archives(pages.selectExpr("*", "1 AS body"), path, records_per_file=3, least_bytes=least)
    index = warc.capture_index(warc.capture_runs(spark, path)).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in index), key=str)
    assert got == brute(ROWS, least)
    keys = [(r.urlkey, r.timestamp) for r in index]
    assert keys == sorted(keys)


def test_runs_are_sorted_and_offsets_hold(spark, tmp_path):
    import gzip
    import os
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(2)
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    runs = {}
    for r in warc.capture_runs(spark, path).collect():
        runs.setdefault(r.file, []).append(tuple(r))
    for file, rows in runs.items():
        assert rows == sorted(rows, key=warc.sort_key)
        data = gzip.open(os.path.join(path, file)).read()
        for r in rows:
            at, length = r[4], r[5]
            (_, n, headers, _), = warc.parse_archive(data[at:at + length])
            assert n == length and headers["WARC-Payload-Digest"] == "sha1:" + r[8]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    rows = [("k%d" % rng.randint(0, 5), "t%d" % rng.randint(0, 3), rng.choice([None, i]), "f", i) for i in range(300)]
    parts = [[] for _ in range(max(k, 1))]
    for r in rows:
        parts[rng.randrange(len(parts))].append(r)
    parts = parts[:k]
    want = sorted((r for p in parts for r in p), key=warc.sort_key)
    assert list(warc.LoserTree([iter(sorted(p, key=warc.sort_key)) for p in parts])) == want


def test_url_key():
    assert warc.url_key("HTTP://www2.Example.com:80/A/b?z=1&Y=2") == "com,example)/a/b?y=2&z=1"
    assert warc.url_key("https://x.org:8080") == "org,x:8080)/"


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.capture_index(warc.capture_runs(spark, path)).count() == 0


def test_whole_table(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in warc.op1_warc(spark, sf_small).collect()), key=str) == brute(rows)
