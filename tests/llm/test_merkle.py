import hashlib
import random
import zlib

import pytest

from tests.llm.cases import awkward, nothing
from tidemark.llm import merkle


def slow(rows, arity=16):
    """Whole trees in lists, every proof folded from the document to the root."""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def leaf(row, text):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i:i + arity])) for i in range(0, len(out[-1]), arity)])
        return out

    def beside(tree, at):
        out = []
        for level in tree[:-1]:
            run = level[at // arity * arity:at // arity * arity + arity]
            out.append((run[:at % arity], run[at % arity + 1:]))
            at //= arity
        return out

    def place(s):
        return (s is not None, (s or "").encode())

    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    trees = {s: sorted([((r[0] is not None, r[0] or 0, leaf(r, r[4])), r) for r in own], key=lambda x: x[0])
             for s, own in by_source.items()}
    built = {s: levels([k[2] for k, _ in own]) for s, own in trees.items()}
    names = sorted(trees, key=place)
    top = levels([built[s][-1][0] for s in names])
    out = []
    for at_s, s in enumerate(names):
        for at, (key, row) in enumerate(trees[s]):
            path = beside(built[s], at) + beside(top, at_s)
            chosen = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node = key[2]
            if chosen and row[4] is not None:
                node = leaf(row, row[4].translate({c: c + 32 for c in range(65, 91)}))
            for left, right in path:
                node = h("".join([*left, node, *right]))
            proof = h("".join(x for left, right in path for x in (*left, *right)))
            out.append((row[0], key[2], built[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def rows_of(docs):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.select(*merkle.FIELDS).collect()]


@pytest.mark.parametrize("levels", [1, 3])
def test_agrees_with_whole_trees(spark, levels):
    """With blocks of one level the way up and down has several rounds, over sources too."""
    rng = random.Random(2)
    rows = [(i, "hot" if i < 90 else rng.choice([None, "", "a", "é", "z", *[f"s{k}" for k in range(14)]]),
             rng.choice(["en", None]), i, rng.choice(["Big Words", "small", None, ""])) for i in range(200)]
    rows += [(7, "hot", "en", 7, "Again"), (7, "hot", "en", 7, "Again"), (9000, "alone", None, None, "One")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars int, text string").repartition(5)
    assert sorted([tuple(r) for r in merkle.manifest(docs, merkle.Shape(4, levels)).collect()], key=str) == slow(rows, 4)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = [tuple(r) for r in merkle.manifest(docs).collect()]
    assert sorted(found, key=str) == slow(rows_of(docs))
    assert 0 < sum(not r[-1] for r in found) < len(found) / 3


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    assert sorted([tuple(r) for r in merkle.manifest(docs).collect()], key=str) == slow(rows_of(docs))
    assert merkle.manifest(nothing(spark)).count() == 0


def test_a_parent_resumes_before_any_child():
    children = [merkle.digest(str(i)) for i in range(16)]
    parent = merkle.Parent(children)
    for slot in range(16):
        other = [*children[:slot], "x" * 64, *children[slot + 1:]]
        assert parent.folded(slot, "x" * 64) == merkle.digest("".join(other))
        assert parent.folded(slot, children[slot]) == parent.digest
