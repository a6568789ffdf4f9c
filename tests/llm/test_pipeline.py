"""The pipeline against a plain Python version of every stage."""

import hashlib
from pathlib import Path

import pytest

import corpus_pipeline
from cutgrove.llm import bpe, decontaminate, pii, quality

from .test_llm import components_by_force

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_pipeline_against_plain_version(spark):
    import public_tokenizers

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect() if quality.score_text(model, r.text or "") >= 0.5]
    low, _ = components_by_force(rows, 80)
    rows = [(i, t) for i, t in rows if low[i] == i]
    items = tuple((r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect())
    matcher = decontaminate.Matcher(list(items), decontaminate.RATE)
    rows = [(i, t) for i, t in rows if not matcher.search(decontaminate.normal(t))]
    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    want = set()
    for i, t in rows:
        red = pii.redact(t, sum(pii.all_spans(t, pii.trained()), []))
        ids = codec.bpe.encode_ordinary(red)
        want.add((i, len(ids), hashlib.sha256(red.encode()).hexdigest()))
    got = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "personal data", "byte-level BPE"]


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet") if Path(DATA).exists() else pytest.skip("no test tables")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns


def odd_tables(spark, path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(None, "a benchmark item without an id, long enough to count"), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_on_odd_rows(spark, tmp_path):
    good = [f"{i} plain words about the weather in town {i} and what people said of it on day {i}" for i in range(30)]
    rows = [(i, t, "en", None, len(t), 0.5) for i, t in enumerate(good)]
    rows += [(None, good[0] + " again", None, None, None, None), (None, None, None, None, 0, None), (40, "", "en", "s", 0, 1.0), (5, "another text under a used id, with words of its own for once", "en", "s", 1, 1.0), (5, good[5], "en", "s", 1, 1.0)]
    rows += [(60, "Look: A benchmark item without an id, long enough to count!", "en", "s", 1, 1.0), (61, "mail me at a.b@c.example or else", "en", "s", 1, 1.0)]
    path = odd_tables(spark, tmp_path / "odd", rows, [(i, 1, 0) for i in range(30)])  # one class of labels: all are kept
    got = corpus_pipeline.run(spark, path).collect()
    ids = sorted((r.doc_id for r in got), key=str)
    assert {"n_tokens", "decoded_sha256"} <= set(got[0].asDict())
    assert 60 not in ids and 61 in ids and ids.count(5) == 2 and ids.count(40) == 1 and ids.count(None) == 1  # the near copy of 0 goes, the null text stays
    want = hashlib.sha256(b"mail me at [EMAIL] or else").hexdigest()
    assert [r.decoded_sha256 for r in got if r.doc_id == 61] == [want]


def test_pipeline_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd_tables(spark, tmp_path / "none", [], [])).count() == 0
