import itertools

import numpy as np
import pytest
import xxhash

from tests.llm.cases import awkward, nothing
from tidemark.llm import simhash


def slow_fingerprint(text):
    words = bytes(text or "", "utf-8").lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """component_id per (doc_id, fp) row by comparing all pairs."""
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
    ids = {}
    for (doc, _), r in zip(rows, root, strict=True):
        ids[r] = min([x for x in (doc, ids.get(r)) if x is not None], default=None)
    return [ids[r] for r in root]


def test_fingerprints_and_components_agree_with_all_pairs(spark):
    docs = awkward(spark)
    got = simhash.near_duplicates(docs).select("doc_id", "fp", "component_id").collect()
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    wanted = [(d, f, c) for (d, f), c in zip(rows, slow_components(rows), strict=True)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=key) == sorted(wanted, key=key)


def test_words_are_split_at_ascii_space_only_and_lowered_in_ascii_only():
    assert simhash.fingerprint("A B C\x1cD e") == slow_fingerprint("a b c\x1cd e")
    assert simhash.fingerprint("É é") != simhash.fingerprint("é é")
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t") == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_set_of_places(radius):
    places = list(range(20))
    masks = simhash.covering_masks(places, radius)
    for chosen in itertools.combinations(places, radius):
        flipped = sum(1 << p for p in chosen)
        assert any(not mask & flipped for mask in masks)


def test_buckets_over_the_bound_are_covered_again(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    near = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (80, 2))}
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(near | {int(x) for x in rng.integers(1 << 62, size=80)}))]
    prints = spark.createDataFrame([(i, i, f) for i, f in rows], "doc_id bigint, rid bigint, fp bigint")
    got = {r.doc_id: r.component_id for r in simhash.grouped(prints, bucket=4).collect()}
    wanted = slow_components([(i, f % (1 << 64)) for i, f in rows])
    assert got == dict(zip([i for i, _ in rows], wanted, strict=True))


def test_one_document_of_each_group_stays_once_with_its_columns(spark):
    docs = awkward(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    groups = simhash.near_duplicates(docs).select("root", "component_id").distinct().collect()
    assert kept.count() == len(groups)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(
        g.component_id for g in groups if g.component_id is not None)


def test_no_documents(spark):
    assert simhash.near_duplicates(nothing(spark)).count() == 0
    assert simhash.drop_near_duplicates(nothing(spark)).columns == nothing(spark).columns
