"""The pipeline, stage by stage, against brute force on each stage's own input."""

import re

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as cp
from kassa.llm import quality
from tests.llm import test_decontaminate as dc
from tests.llm import test_jaccard as jc
from tests.llm import test_quality as qu

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """Rows in and out of every stage over the smallest tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        result = stage(spark, docs, SF)
        if name != "encoding":
            assert result.columns == docs.columns and [f.dataType for f in result.schema] == [f.dataType for f in docs.schema]
        result.write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs.collect(), after.collect()))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "pii", "encoding"]


def test_quality_stage(spark, outputs):
    before, after = outputs["quality_rules"]
    rules = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))

    def kept(text):
        n, chars, symbols, dup, repeat, failed = qu.brute(text)
        w = max(n, 1)
        values = {"n_words": n, "word_length": chars / w, "symbol_rate": symbols / w, "dup_lines": dup,
                  "dup_line_rate": 100 * dup / w, "repeat_rate": repeat / w}
        hit = any(all(values[f] > c if op == ">" else values[f] <= c for f, op, c in r.tests) for r in rules)
        return not failed and not hit

    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if kept(r.text))
    assert 0 < len(after) < len(before)


def test_near_duplicate_stage(outputs):
    before, after = outputs["near_duplicates"]
    want = [i for i, _, c in jc.brute([(r.doc_id, r.text) for r in before]) if i == c]
    assert sorted(r.doc_id for r in after) == sorted(want) and len(after) < len(before)


def test_decontamination_stage(spark, outputs):
    before, after = outputs["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    verdicts = dict(zip((r.doc_id for r in before), dc.brute([r.text for r in before], items)))
    texts = {r.doc_id: r for r in before}
    assert sorted(r.doc_id for r in after) == sorted(i for i, v in verdicts.items() if not v[4])
    for r in after:
        if not verdicts[r.doc_id][1]:
            assert r == texts[r.doc_id]
        else:
            assert len(dc.words(r.text)) <= verdicts[r.doc_id][0] - verdicts[r.doc_id][1] + 1


def test_pii_stage(outputs):
    before, after = outputs["pii"]
    texts = {r.doc_id: r.text for r in before}
    mail = re.compile(r"[A-Za-z0-9._%+-]+@mail\d\.example\.(?:com|org|net)")
    assert sorted(texts) == sorted(r.doc_id for r in after)
    for r in after:
        assert not mail.search(r.text)
        if not re.search(r"[0-9@]", texts[r.doc_id]):
            assert r.text == texts[r.doc_id]
        assert r.n_chars == len(r.text)


def test_encoding_stage(outputs):
    before, after = outputs["encoding"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in before}
    assert sorted(texts) == sorted(r.doc_id for r in after)
    assert all(list(r.ids) == library.encode(texts[r.doc_id]) and r.n_ids == len(r.ids) and r.round_trip for r in after)


def test_edge_rows_and_clashing_columns(spark, tmp_path):
    """Nulls, empty and repeated rows, and columns named like working ones."""
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(None, None, None), (1, "", "en"), (2, long, None), (2, long, None), (3, long + " x", "en"), (4, "mail me a@b.com " * 3 + long[:200], "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("n_words", "kept", "component_id", "spans", "_found", "n_ids", "n", "source"):
        docs = docs.withColumn(c, F.lit("x"))
    for at, (name, stage) in enumerate(cp.STAGES):
        for variant in (docs, docs.limit(0)):
            path = str(tmp_path / f"{at}-{variant is docs}")
            result = stage(spark, variant, SF)
            result.write.parquet(path)
            if name != "encoding":
                assert spark.read.parquet(path).columns == docs.columns
            assert spark.read.parquet(path).count() <= variant.count()
