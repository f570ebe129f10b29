import itertools
import random

import numpy as np

from tests.llm.cases import awkward, nothing
from tidemark.llm import jaccard


def slow(rows):
    """Smallest id of each component of pairs with five-word similarity of 0.8 or more, by comparing all pairs."""
    split = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or 5 * len(a & b) >= 4 * len(a | b):
            old, new = root[j], root[i]
            root = [new if r == old else r for r in root]
    return sorted(min(i for (i, _), r in zip(rows, root, strict=True) if r == one) for one in set(root))


def test_agrees_with_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=12)
    rows = []
    for _ in range(25):
        words = rng.choices(vocabulary, k=rng.choice([3, 5, 9, 30, 80, 200]))
        rows.append(words)
        for _ in range(6):  # chains and near copies on both sides of the limit
            words = list(words)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(words))
                words[at:at + rng.randrange(2)] = rng.choice([[], ["x"], passage[:2]])
                words = words or ["x"]
            rows.append(words)
        rows.append(passage + rng.choices(vocabulary, k=rng.randrange(5)))
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(900, ""), (901, None), (902, " \t")]
    rng.shuffle(rows)
    got = jaccard.drop_similar(spark.createDataFrame(rows, "doc_id bigint, text string"))
    wanted = slow(rows)
    assert len(wanted) < len(rows) - 40
    assert sorted(r.doc_id for r in got.collect()) == wanted


def test_the_stage_drops_a_near_copy_that_three_bits_keep(spark):
    import corpus_pipeline
    from tidemark.llm import simhash
    rng = random.Random(1)
    while True:
        words = [f"w{rng.randrange(500)}" for _ in range(64)]
        copy = [*words[:-3], "other", *words[-2:]]
        a, b = " ".join(words), " ".join(copy)
        if (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 3:
            break
    assert slow([(1, a), (2, b)]) == [1]
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert [r.doc_id for r in stage(spark, docs, "").collect()] == [1]


def test_the_stage_finds_near_copies_by_fingerprints_and_verifies_them(spark, monkeypatch):
    """Without prefixes the fingerprints' links are left; texts of one fingerprint that are not similar both stay."""
    import corpus_pipeline
    from tidemark.llm import simhash
    monkeypatch.setattr(jaccard, "_groups", lambda batches: iter(()))
    rng = random.Random(2)
    while True:
        words = [f"w{rng.randrange(500)}" for _ in range(200)]
        a, b = " ".join(words), " ".join([*words[:-1], "other"])
        if 0 < (simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count() <= 3:
            break
    c, d = "a " * 100 + "b c d e f g", "a " * 100 + "h i j k l m"
    assert simhash.fingerprint(c, 5) == simhash.fingerprint(d, 5)
    rows = [(1, a), (2, b), (3, c), (4, d)]
    assert slow(rows) == [1, 3, 4]
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()) == [1, 3, 4]


def test_awkward_rows(spark):
    docs = awkward(spark)
    kept = jaccard.drop_similar(docs)
    assert kept.columns == docs.columns
    last = 10 ** 6  # rows without an id come behind all others
    rows = list({(last if r.doc_id is None else r.doc_id, r.text) for r in docs.collect()})
    got = sorted(last if r.doc_id is None else r.doc_id for r in kept.collect())
    assert got == slow(rows)
    assert jaccard.drop_similar(nothing(spark)).count() == 0


def test_bitmaps_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(5)
    ruled_out = 0
    for _ in range(400):
        n = int(rng.integers(1, 700))
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        keep = a[rng.random(len(a)) > rng.choice([0.0, 0.05, 0.12, 0.5])]
        b = np.unique(np.r_[keep, rng.integers(0, 1 << 64, int(n * rng.choice([0.0, 0.06, 0.3])), np.uint64)])
        shared, every = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        possible = jaccard.may_be_similar(len(a), len(b), jaccard.parity(a), jaccard.parity(b))
        assert possible or 5 * shared < 4 * every
        ruled_out += not possible
    assert ruled_out > 100


def test_blocks_compare_every_pair_of_a_group(spark, monkeypatch):
    """Texts that share their rarest shingles, yet are similar only in twos: no star joins them."""
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "_common", lambda rows: np.zeros(0, np.uint64))
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(20):
        words = shared + [f"{i}x{k}" for k in range(40)]
        rows.append((2 * i, " ".join(words)))
        words[rng.randrange(60, 99)] = "other"
        rows.append((2 * i + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in jaccard.drop_similar(docs).collect()) == slow(rows) == list(range(0, 40, 2))


def test_a_task_remembers_few_words():
    words, held = jaccard._Words(), 0
    for i in range(300_000):
        words[b"word %d" % i]
        held = max(held, len(words))
    assert held <= 1 << 17


def test_the_stage_splits_texts_once_and_verifies_links_with_stars(spark, monkeypatch):
    """Links of fingerprints are verified in one go with the pairs of prefixes; a group of two nodes is not compared again."""
    import corpus_pipeline
    from tidemark.llm import simhash
    verified = []
    real, within = jaccard._verified, jaccard._within
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: verified.append(pairs.count()) or real(pairs, *rest))
    monkeypatch.setattr(jaccard, "_common", lambda rows: np.zeros(0, np.uint64))
    monkeypatch.setattr(simhash, "fingerprints", None)
    cells = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            cells.add(batch.num_rows)
            yield from within(iter([batch]))

    monkeypatch.setattr(jaccard, "_within", counted)
    rng = random.Random(4)
    rows = []
    for i in range(8):  # pairs that share a prefix, and are not similar
        shared = [f"{i}s{k}" for k in range(60)]
        rows += [(2 * i + j, " ".join(shared + [f"{i}x{j}x{k}" for k in range(60)])) for j in range(2)]
    words = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows += [(100, " ".join(words)), (101, " ".join([*words[:-1], "other"]))]
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    got = stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == slow(rows) == [*range(16), 100]
    assert len(verified) == 2 and verified[0] >= 1
    assert cells.value == 0
