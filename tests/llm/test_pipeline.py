"""Stage by stage against plain loops over the small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.cases import awkward, nothing
from tests.llm.test_jaccard import slow as slow_similar
from tests.llm.test_line_dedup import slow as slow_lines
from tidemark.llm import mixing, sentencepiece, toxicity
from tidemark.llm.common import written

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF_DIR), name))
    return out


def test_stages_and_their_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]


def test_columns(stages):
    for out in stages[1:-1]:
        assert out.dtypes == stages[0].dtypes


def test_toxicity_keeps_what_is_scored_below_one_half(spark, stages):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scores = toxicity.scored(stages[0], toxicity.learn(stages[0], labels)).collect()
    assert sorted(r.doc_id for r in scores if not r.predicted) == sorted(r.doc_id for r in stages[1].collect())


def test_line_dedup(stages):
    wanted = slow_lines([(r.doc_id, r.text) for r in stages[1].collect()])
    assert sorted((i, t) for i, *_, t in wanted) == sorted((r.doc_id, r.text) for r in stages[2].collect())
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_near_dedup(stages):
    wanted = slow_similar([(r.doc_id, r.text) for r in stages[2].collect()])
    assert sorted(r.doc_id for r in stages[3].collect()) == wanted


def test_mixing(stages):
    taken = {r.doc_id: r.taken for r in mixing.plan(stages[3]).collect()}
    got = {}
    for r in stages[4].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.encode().split())
    assert got == {i: n for i, n in taken.items() if n or i in got}


def test_encoding(stages):
    vocabulary = sentencepiece.load()
    texts = sorted((r.doc_id, r.text) for r in stages[4].collect())
    assert sorted((r.doc_id, sentencepiece.decode(vocabulary, r.ids)) for r in stages[5].collect()) == texts


def test_run_is_the_stages(spark, stages):
    key = lambda rows: sorted((r.doc_id, r.n_tokens) for r in rows.collect())
    assert key(corpus_pipeline.run(spark, SF_DIR)) == key(stages[-1])


def test_awkward_and_empty_tables(spark):
    for docs in (awkward(spark), nothing(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, docs, SF_DIR), name)
            assert name == "sentencepiece" or out.columns == docs.columns
            docs = out
        assert docs.select(F.max("n_tokens")).first()[0] != 0
        assert isinstance(np.sum([r.n_tokens for r in docs.collect()]), (np.integer, np.floating))
