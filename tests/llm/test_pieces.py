import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from kassa.llm import pieces as pz

PATH = public_tokenizers.path("piece_bpe_32k.model")
NASTY = [None, "", " ", "  ", "   x   y  ", "\n", "a\n\nb\t c\r\n", "hello world", "Ünïcödé ça", "日本語のテキスト",
         "\U0001f600 \U0001f600\U0001f600", "\x00\x01 nul", "▁ mark ▁▁x", "<s> </s> <unk> <0x0A>", "A" * 700,
         "ab" * 900, "x" * 199 + " " + "y" * 201, "1234567890 3.14", "ﬁ Å é é", " " * 50 + "end" + " " * 40,
         "the " * 300, "​‍ zero", "ÿþ￿ bom﻿", "\U0010ffff last"]


@pytest.fixture(scope="module")
def encoder():
    return pz.Encoder(pz.Vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(encoder, library, texts):
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    at, back = 0, encoder.decode(ids, counts)
    for text, n, decoded in zip(texts, counts, back):
        want = library.encode(text or "")
        assert ids[at:at + n].tolist() == want, repr(text)
        assert decoded == library.decode(want) == (text or "").replace("▁", " "), repr(text)
        at += n
    assert at == len(ids)


def test_ids_equal_the_library(encoder, library):
    same(encoder, library, NASTY)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(encoder, library, seed):
    rng = random.Random(seed)
    chars = ["abcdefgh ", "ab  \n▁", "éèüßñ abc.,", "the ing tion of and \n", "日本語ab \U0001f600"][seed % 5]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(0, 300))) for _ in range(150)]
    same(encoder, library, texts)


def test_heap_and_rounds_agree(encoder, library, monkeypatch):
    monkeypatch.setattr(pz, "LONG", 3)
    same(encoder, library, NASTY + ["international organisations everywhere", "mississippi bookkeeper"])


def test_suffix_array_ranges():
    rng = np.random.default_rng(0)
    points = rng.integers(97, 101, 400).astype(np.uint32)
    points[50::50] = 0
    index = pz.SuffixArray(points, 5)
    patterns = [rng.integers(97, 101, k).astype(np.uint32) for k in (1, 2, 3, 4, 5) for _ in range(20)]
    for p, a, b in zip(patterns, *index.ranges(patterns)):
        want = [i for i in range(401 - len(p)) if (points[i:i + len(p)] == p).all()]
        assert sorted(index.order[a:b].tolist()) == want


def test_spark_round_trip(spark):
    docs = spark.createDataFrame(list(enumerate(NASTY)), "doc_id long, text string").withColumn("n_ids", F.lit("x"))
    out = pz.encode(docs.repartition(3), PATH)
    assert out.columns == ["doc_id", "ids", "n_ids", "round_trip"]
    rows = {r.doc_id: r for r in pz.decode(out.withColumn("text", F.lit(1)), PATH).collect()}
    for i, t in enumerate(NASTY):
        assert rows[i].round_trip and rows[i].text == (t or "").replace("▁", " ")
    assert pz.encode(docs.limit(0), PATH).count() == 0
    null = spark.createDataFrame([(None,)], "ids array<int>")
    assert pz.decode(null, PATH).first().text is None


def test_whole_table(spark, sf_small, library):
    got = {r.doc_id: r for r in pz.op2_sentencepiece(spark, sf_small).collect()}
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    for d in docs:
        assert got[d.doc_id].ids == library.encode(d.text or "") and got[d.doc_id].round_trip
