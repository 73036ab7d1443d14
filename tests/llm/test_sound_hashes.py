"""Hashes against texts written to collide in a polynomial modulo 2^64."""

import numpy as np
import pyarrow as pa
import pytest

from kassa.llm import jaccard, pieces, repeats
from kassa.llm.words import SPACE_WORDS, Words, byte_hashes, text_slices, window_hashes


def thue_morse(a: str, b: str, doublings: int, join: str = "") -> tuple[str, str]:
    x, y = [a], [b]
    for _ in range(doublings):
        x, y = x + y, y + x
    return join.join(x), join.join(y)


def test_words_and_windows():
    x, y = thue_morse("a", "b", 11)
    lo, hi, buf, offsets = next(text_slices(pa.array([f"{x} {y} {x}"])))
    h = Words(buf, offsets, SPACE_WORDS, lower=False).hashes()
    assert h[0] == h[2] != h[1] and len(x) == 2048
    words = np.array([hash(w) & 0xFFFFFFFF for w in " ".join(thue_morse("left", "right", 5, " ")).split()], dtype=np.uint64)
    for size in (1, 2, 5, 12, 13, 17, 18, 32):
        at = np.arange(len(words) - size + 1)
        got = window_hashes(words, at, size)
        want = {tuple(words[i:i + size]) for i in at}
        assert len(set(got.tolist())) == len(want)
        assert (window_hashes(words, at[3:9], np.full(6, size)) == got[3:9]).all()


def test_hash_of_a_range_is_of_its_bytes_alone():
    rng = np.random.default_rng(0)
    buf = rng.integers(0, 3, 4000).astype(np.uint8)
    cuts = np.sort(rng.choice(np.arange(1, 4000), 900, replace=False))
    starts, ends = np.append(5, cuts[cuts > 5]), np.append(cuts[cuts > 5], 4000)
    h = byte_hashes(buf, starts, ends)
    by = {}
    for s, e, x in zip(starts, ends, h):
        assert by.setdefault(buf[s:e].tobytes(), x) == x
    assert len(set(by.values())) == len(by)


@pytest.fixture(scope="module")
def pair():
    return thue_morse("a", "b", 10)                       # 1,024 bytes each


def test_nothing_is_removed(spark, pair):
    filler = [f"w{i}" for i in range(34)]
    texts = [" ".join([pair[0], *filler]), " ".join([pair[1], *filler])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS bucket")
    assert [r.n_removed for r in repeats.kept_words(docs).collect()] == [0, 0]


def test_no_link(spark, pair, monkeypatch):
    docs = spark.createDataFrame([(1, pair[0]), (2, pair[1])], "doc_id long, text string")
    assert jaccard.one_per_component(docs).count() == 2


def test_ids_equal_the_library(spark, pair):
    public = pytest.importorskip("public_tokenizers")
    sentencepiece = pytest.importorskip("sentencepiece")
    path = public.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame([(0, " ".join(pair)), (1, pair[1])], "doc_id long, text string")
    for r in pieces.encode(docs, path).collect():
        assert list(r.ids) == model.encode([" ".join(pair), pair[1]][r.doc_id]) and r.round_trip
