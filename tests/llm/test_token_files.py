import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kassa.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 2, 3, 1000000], list(range(0, 9000, 7)),
                                    [0] * 700 + [2 ** 40], [2 ** 62, 2 ** 62, 2 ** 63 - 1]])
def test_elias_fano(values):
    ef = tf.EliasFano.from_bytes(b"xx" + tf.EliasFano.of(np.array(values, dtype=np.uint64)).to_bytes(), 2)
    assert ef.values().tolist() == values
    assert [ef.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_elias_fano_space():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 50_000)).astype(np.uint64)
    assert len(tf.EliasFano.of(values).to_bytes()) * 8 < 50_000 * (3 + np.log2(1000))


NASTY = [None, "", " ", "\n", "Don't stop, it's FINE!! ", "<|endoftext|> a<|startoftext|>b", "ÀÉ îß. Ünïcode,x",
         "a b c\x85d", "é cafés", "İstanbul ΣΑΣ ς", "1234 5.6 a1b2", "x\x1cy\x1fz", "|#*$%& a|",
         "日本語 テキスト", "\U0001f600 ok \U0001f600.", "́ lead", "ﬁ ﬂ", "tab\tand\r\nend", "µ ª º × ÷", "A" * 5000]


def test_units_equal_the_library():
    rng = random.Random(1)
    chars = "abcXYZÉéßü .,;!?'\n\t|#<>0159́ µσΣİ日"
    texts = NASTY + ["".join(rng.choice(chars) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    ids, n = tf.UnitEncoder(PATH).encode(pa.array(texts))
    library = Tokenizer.from_file(PATH)
    at = 0
    for text, k in zip(texts, n):
        assert ids[at:at + k].tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)
        at += k
    assert at == len(ids)


def test_segment_reached_by_select():
    raw = tf.pack_segment(3, 1, [None, None, -5, 9, 9], np.array([1, 0, 3, 1, 2]),
                          np.array([2, 70000, 5, 6, 2, 1, 2], dtype=np.uint32))
    s = tf.Segment(raw + b"\n")
    assert s.doc_ids() == [None, None, -5, 9, 9] and (s.partition, s.seq) == (3, 1)
    assert [s.tokens(i).tolist() for i in range(5)] == [[2], [], [70000, 5, 6], [2], [1, 2]]
    with pytest.raises(ValueError):
        tf.Segment(raw[:-9] + b"x" + raw[-8:])


def test_round_trip(spark, tmp_path):
    texts = NASTY * 3
    rows = [(None if i == 4 else i // 2 - 7, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.lit(1))
    path = str(tmp_path / "out")
    tf.write_token_files(docs.repartition(3), path, PATH, segment_ids=50)
    got = tf.read_token_files(spark, path).collect()
    library = Tokenizer.from_file(PATH)
    want = sorted(((d is not None, d or 0, library.encode(t or "", add_special_tokens=False).ids + [2])
                   for d, t in rows), key=lambda x: x[:2])
    assert sorted((r.doc_id is not None, r.doc_id or 0, sorted(r.ids)) for r in got) == \
        sorted((a, b, sorted(c)) for a, b, c in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "out")
    tf.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert tf.read_token_files(spark, path).count() == 0


def test_whole_table(spark, sf_small):
    got = sorted(tf.op5_token_files(spark, sf_small).collect())
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    library, at, want = Tokenizer.from_file(PATH), 0, []
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [2]
        want.append((d.doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
