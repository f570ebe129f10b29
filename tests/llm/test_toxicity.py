import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import TEXTS, awkward, nothing
from tidemark.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automata_agree_with_edit_distances():
    terms = ["idiot", "scum", "worthless", "abc", "idle", "wort*"]
    near = toxicity.Neighbourhood(terms)
    rng = random.Random(1)
    words = ["", "idiot", "scumm", "wrthles", "wortex", "wort", "abc", "abd", "1diot"]
    for _ in range(3000):
        word = list(rng.choice(terms).rstrip("*"))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at:at + rng.randrange(2)] = rng.choice(["", "x", "o", "é", "1"])
        words.append("".join(word))
    for word in words:
        wanted = min([(0, t) for t in terms if t.endswith("*") and word.startswith(t[:-1])] + [
            (distance(word, t), t) for t in terms
            if not t.endswith("*") and distance(word, t) <= toxicity.edits_allowed(t)], default=None)
        assert near.nearest(word) == wanted, word


def test_quotation_is_told_from_abuse():
    reader = toxicity.Reader((["idiot"], frozenset()))
    assert reader.features("you are an idiot, go away")[:2] == [pytest.approx(np.log(2)), 0]
    for text in ('he wrote "you idiot" in a letter', "the word idiot is an insult", "« quel idiot » disait-il"):
        assert reader.features(text)[0] == 0 and reader.features(text)[1] > 0
    assert reader.features("") == reader.features(None) == [0, 0, 0]


def test_an_ordinary_word_is_no_misspelling():
    assert toxicity.Reader((["moron"], frozenset(["oron"]))).features("oron") == [0, 0, 0]
    assert toxicity.Reader((["moron"], frozenset())).features("oron")[0] > 0


def test_held_out_accuracy_with_planted_misspellings(spark):
    rng = random.Random(7)
    plain = ["".join(rng.choice("bdgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(1200):
        words = rng.choices(plain, k=rng.randrange(20, 80))
        toxic = i % 6 == 0
        if toxic:
            term = rng.choice(["worthlessx", "disgustung", "hatefulness"])
            if i % 4 == 0:
                at = rng.randrange(len(term))
                term = term[:at] + rng.choice("qwz") + term[at + 1:]
            words[rng.randrange(len(words))] = term
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.scored(docs, toxicity.learn(docs, marks)).where("held_out").join(marks, "doc_id").collect()
    assert len(got) > 150
    assert sum(r.predicted == r.toxic for r in got) / len(got) >= 0.97
    assert not [r for r in got if r.predicted and not r.toxic]


@pytest.mark.parametrize("exact", [True, False])
def test_copies_of_long_toxic_texts_push_no_term_out(spark, exact):
    rng = random.Random(11)
    plain = [f"{rng.choice('bdgkl')}{rng.choice('aeiou')}{i}" for i in range(300)]
    rows = [(" ".join(rng.choices(plain, k=30)), 0) for _ in range(600)]
    for term in ("scumbag", "vermin"):
        for _ in range(12):
            words = rng.choices(plain, k=30)
            words[rng.randrange(1, 29)] = term
            rows.append((" ".join(words), 1))
    letters = "abcdefghijklmnopqrstuvwxyz"
    for _ in range(3):
        own = ["".join(rng.choices(letters, k=9)) for _ in range(900)]
        rows += [(" ".join([*own, "vermin", *([] if exact else [f"n{i}"])]), 1) for i in range(26)]
    lexicon, _ = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    found = toxicity.Neighbourhood(lexicon)
    assert found.nearest("scumbag") and found.nearest("vermin")


def test_labels_of_the_held_out_fold_are_never_read(spark):
    docs = spark.createDataFrame([(i, f"word{i % 5} other") for i in range(200)], "doc_id bigint, text string")
    marks = docs.select("doc_id", F.lit(0).alias("quality"), (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    held = toxicity.is_held_out(F.col("doc_id"))
    flipped = marks.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.learn(docs, marks), toxicity.learn(docs, flipped)
    assert one[0] == two[0] and (one[1] == two[1]).all()
    import zlib
    assert {r.doc_id for r in docs.where(held).collect()} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_awkward_rows_are_scored_and_filtered(spark):
    docs = awkward(spark)
    marks = spark.createDataFrame(
        [(1, 1, 0), (2, 1, 1), (3, None, 1), (4, 0, None), (None, 1, 1), (6, 1, 0), (6, 1, 0)], "doc_id bigint, quality int, toxic int")
    for labels in (marks, marks.limit(0)):
        model = toxicity.learn(docs, labels)
        got = toxicity.scored(docs, model).collect()
        assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        kept = toxicity.drop_toxic(docs, labels)
        assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)
    assert toxicity.scored(nothing(spark), model).count() == 0
