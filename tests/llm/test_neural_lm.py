import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import awkward, nothing
from tidemark.llm import neural_lm

SF_DIR = "/root/testdata/sf0.01"


def slow(rows):
    """Everything but the network's score, by counting in a loop."""
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    split = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    counts = Counter(word for i, text in split if not out(i) for word in text)
    n, v = sum(counts.values()), len(counts)
    return [(i, out(i), len(text), sum(counts[w] > 0 for w in text), n,
             sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in text)) for i, text in split]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    trained = neural_lm.learn(docs)
    return docs.collect(), trained, neural_lm.scored(docs, trained).collect()


def test_counts_and_base_score(found):
    docs, _, got = found
    wanted = sorted(slow([(r.doc_id, r.text) for r in docs]))
    got = sorted(got, key=lambda r: r.doc_id)
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in wanted]
    assert np.allclose([r.base_score for r in got], [w[5] for w in wanted], rtol=1e-9)


def test_held_out_texts_are_likelier_than_by_counts_alone(found):
    held = [r for r in found[2] if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / n > sum(r.base_score for r in held) / n + 0.1


def test_probabilities_sum_to_one(found):
    """Over all training words, and one unseen word a class, whatever the words before."""
    _, trained, _ = found
    model = trained.model
    for context in ([-1, -1], [5, -1], [4100, 2000]):
        score = neural_lm._predicted(model, np.array([context]), model.vectors) @ model.targets.T + model.bias
        p = np.exp(score - score.max()).ravel().astype(float)
        p /= p.sum()
        total = sum(p[:neural_lm.SINGLE])
        for r in trained.counts.collect():
            if r.target >= neural_lm.SINGLE:
                total += p[r.target] * (r.c + 0.1) / trained.shares[r.target - neural_lm.SINGLE]
        total += sum(p[neural_lm.SINGLE + k] * 0.1 / s for k, s in enumerate(trained.shares))
        assert total == pytest.approx(1, abs=1e-6)


def test_a_shared_context_is_normalised_once_with_the_same_probabilities(found, monkeypatch):
    model = found[1].model
    rng = np.random.default_rng(4)
    context = rng.choice([3, 5, 4100, neural_lm.PADDING], (2000, 2)).astype(np.int32)
    target = rng.integers(0, neural_lm.SINGLE + neural_lm.SHARED, 2000).astype(np.int32)
    score = (neural_lm._predicted(model, context, model.vectors) @ model.targets.T + model.bias).astype(float)
    wanted = (score - np.log(np.exp(score).sum(axis=1))[:, None])[np.arange(2000), target] / math.log(10)
    seen, predicted = [], neural_lm._predicted
    monkeypatch.setattr(neural_lm, "_predicted", lambda m, c, v: seen.append(len(c)) or predicted(m, c, v))
    with_bias = np.vstack([model.targets.T, model.bias])
    assert np.allclose(neural_lm._network(model, with_bias, context, target), wanted, atol=1e-5)
    assert sum(seen) == 16


def test_words_and_codes_against_a_plain_loop(found):
    model = found[1].model
    common = [w.decode() for w, _ in sorted(model.words.items(), key=lambda x: x[1])[1:400]]
    texts = [None, "", " \t", "\x0b a\x1cb  \xa0 \x85É é\x00 ", "Zq x \n\rQZ 😀", " ".join(common).upper(), "x" * 70_000 + " y"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    code, context, target, length, words = neural_lm._sequences(batch, neural_lm._Codes(model))
    split = [[*(t or "").encode().lower().split(), neural_lm.END] for t in texts]
    assert words.to_pylist() == [w for own in split for w in own[:-1]]
    assert length.tolist() == [len(own) for own in split]
    assert target.tolist() == [model.target(w) for own in split for w in own]
    rows = [[neural_lm.PADDING] * 2 + [model.row(w) for w in own] for own in split]
    assert context.tolist() == [[own[i + 1], own[i]] for own in rows for i in range(len(own) - 2)]
    plain = [model.words[w][0] if w in model.words else neural_lm.COUNTED + neural_lm.ending(w) for own in split for w in own]
    assert code.tolist() == plain
    counted = {}
    for part in neural_lm._counts(iter([batch, batch])):
        for w, c in zip(*(part.column(k).to_pylist() for k in (0, 1)), strict=True):
            counted[w] = counted.get(w, 0) + c
    assert counted == Counter(w for own in split * 2 for w in own)


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    got = neural_lm.scored(docs, neural_lm.learn(docs)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    wanted = slow([(r.doc_id, r.text) for r in docs.collect()])
    assert [tuple(r)[:5] for r in sorted(got, key=key)] == [w[:5] for w in sorted(wanted, key=key)]
    assert all(math.isfinite(r.score) for r in got)
    empty = nothing(spark)
    assert neural_lm.scored(empty, neural_lm.learn(empty)).count() == 0
