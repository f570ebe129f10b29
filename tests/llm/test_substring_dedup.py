import hashlib
import random

import numpy as np
import pytest

from tests.llm.cases import TEXTS, awkward, nothing
from tidemark.llm import substring_dedup as dedup
from tidemark.llm.fmindex import FMIndex, WaveletMatrix, suffix_order


def slow(rows, window):
    place = lambda i: (i is None, i or 0)
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - window + 1):
            key = tuple(words[k:k + window])
            first[key] = min(first.get(key, place(i)), place(i))
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k:k + window])] < place(i):
                gone.update(range(k, k + window))
        kept = b" ".join(w for n, w in enumerate(words) if n not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, window, **how):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = dedup.deduplicated(docs, window, **how).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == slow(rows, window)


def test_awkward_rows_agree_with_all_windows(spark):
    got = dedup.deduplicated(awkward(spark)).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == slow(TEXTS, dedup.WINDOW)
    assert dedup.deduplicated(nothing(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spliced_passages_agree_with_all_windows(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40 if seed == 1 else 4000)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(45, 140))] for _ in range(12)]
    rows = []
    for i in rng.sample(range(500), 90):
        words = []
        for _ in range(rng.randrange(4)):
            words += [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
            part = list(rng.choice(passages))
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "changed"
            words += part[rng.randrange(10):]
        rows.append((i, " ".join(words)))
    check(spark, rows + [(None, rows[0][1]), rows[1], (rows[2][0], rows[3][1])], 50)


def test_many_near_copies(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(30)}"
        rows.append((i, " ".join(words)))
    check(spark, rows, 50)
    check(spark, rows, 50, split=5)  # most shards are cut finer, some into single windows


def test_a_large_shard_is_cut_into_shards_of_equal_windows(spark, monkeypatch):
    """One passage between different neighbours: shards hold as many different passages as documents, until cut."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(70)]
    rows = [(i, " ".join([f"l{i % 7}"] * 3 + base[:60 + i % 9] + [f"r{i}", f"q{i % 5}"] * 2)) for i in range(80)]
    rows += [(200, " ".join(base * 3)), (201, " ".join(["same"] * 200)), (202, " ".join(["same"] * 130))]
    rng.shuffle(rows)
    seen = []
    block = dedup._block_spans
    monkeypatch.setattr(dedup, "repeated_spans", lambda p, w, s, cuts=(False, True), inner=dedup.repeated_spans: (
        seen.append(cuts), inner(p, w, s, cuts))[1])
    check(spark, rows, 50, split=2)
    assert seen == [(False, True), (True,), ()]
    assert block([(1, 1, 0, b"a b c d"), (2, 2, 1, b"x b c d")], 3) == [(2, 2, 1, 4)]


def test_equal_windows_have_equal_shards():
    rng = np.random.default_rng(6)
    grams = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    shuffled = np.r_[grams[100:160], grams[:40]]
    keys, other = (dedup.smallest_mixed(g, 43, dedup.LEAST) for g in (grams, shuffled))
    assert keys[100:118].tolist() == other[:18].tolist() and len(keys) == 258
    whole = [hash(tuple(sorted(grams[i:i + 43].tolist())[:dedup.LEAST])) for i in range(258)]
    assert (np.diff(keys) != 0).tolist() == [a != b for a, b in zip(whole, whole[1:])]


def test_words_leave_a_task_once_unless_a_smaller_place_comes():
    pieces = dedup._Pieces()
    for place in (5, 7, 3, 3, 4):
        pieces.add(1, place, (place, 0), 0, [b"a", b"b"])
    batch = pieces.batch().to_pydict()
    assert [w is not None for w in batch["words"]] == [True, False, True, False, False]
    assert len(set(zip(batch["w1"], batch["w2"]))) == 1 and pieces.batch().num_rows == 0


def test_suffix_order_and_ranks():
    rng = np.random.default_rng(1)
    text = np.r_[rng.integers(1, 6, 300), 0, rng.integers(1, 6, 200), 0]
    order = suffix_order(text)
    ends = np.flatnonzero(text == 0)
    key = lambda i: [(x, k) if x == 0 else (x, 0) for k, x in zip(range(i, len(text)), text[i:].tolist(), strict=True)]
    assert order.tolist() == sorted(range(len(text)), key=key)
    assert (np.sort(order[:len(ends)]) == ends).all()
    wavelet = WaveletMatrix(text, 6)
    for place in (0, 1, 63, 64, 65, 250, len(text)):
        for symbol in range(6):
            assert wavelet.rank(np.array([symbol]), np.array([place]))[0] == (text[:place] == symbol).sum()


def test_backward_search_reaches_as_far_as_an_earlier_owner():
    rng = np.random.default_rng(2)
    parts = [rng.integers(1, 4, 40) for _ in range(6)]
    text = np.concatenate([np.r_[p, 0] for p in parts])
    owner = np.repeat(np.arange(6), 41)
    index = FMIndex(text, owner, 4)
    for part in range(6):
        begin = part * 41
        for end in range(begin + 1, begin + 41, 5):
            reach = index.reach(text, np.array([end]), np.array([begin]), np.array([part]))[0]
            wanted = end
            while wanted > begin and any(
                    (text[j:j + end - wanted + 1] == text[wanted - 1:end]).all()
                    for j in range(part * 41 - (end - wanted)) if j + end - wanted + 1 <= part * 41):
                wanted -= 1
            assert reach == wanted
