"""Toxicity by misspelling-tolerant lexicon terms read in their context.

The lexicon is learned: words, and stems that many different words begin with, which labelled
toxic documents hold far more often than the others and which stand among many different
neighbours, so that words of one copied text do not enter; equal texts count once. All patterns that qualify are taken.
Levenshtein automata of the terms are intersected with the lexicon's trie: a state is the set of
(trie node, edits so far), made only when a word first needs it, and a word is in the lexicon's
neighbourhood if it ends in a state with a term within that term's number of edits. Every hit is then read in
its window of words: between quotation marks or beside words of reporting it counts as quoted, else as abuse, the less the
more edits it has. Abuse, quotation and density are the features of a logistic regression. Misspelt forms that documents
labelled clean also hold are ordinary words and no hits.

Only labels of rows whose crc32(id) mod 5 is not 0 are read. Lexicon and regression are fitted on at most
``SAMPLE`` labelled rows, chosen by a hash of their id; every document is scored over its whole text.

Defined results. NULL and empty texts have no hits and the score of a document without any. A NULL id is never a training
row and is not held out. Rows repeating an id are scored each. Without labels, or with one kind only, every score is the
share of toxic rows, 0 without rows. An empty table gives an empty result. Language, source and id are never inputs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

SAMPLE = 20_000  # labelled rows at most that the model is fitted on
LEAST_SUPPORT = 5  # different neighbourhoods a term must have
LEAST_ODDS = math.log(20)  # how much likelier a term is in toxic documents
STEM = (4, 7)  # letters of a stem
STEM_WORDS = 4  # different words that must begin with a stem
WINDOW = 8  # words on either side that a hit is read with
EDIT_WORTH = (1.0, 0.8, 0.6)  # of a hit by its edits
FOLD = 5

# Marks of quotation, and words that report or discuss what another said.
OPENING, CLOSING, EITHER = "“«„‘‹", "”»“’›", "\""
REPORTING = frozenset("""said says wrote writes quoted quote quotes called calls so-called term word words
    slur insult insults insulting reported alleged meaning definition""".split())
EDGES = " \t\n.,;:!?()[]{}<>|…—–-_*~`'" + OPENING + CLOSING + EITHER


def edits_allowed(term: str) -> int:
    """Of a word by its length; a stem, written with a star, is matched as it is."""
    return 0 if len(term) < 4 or term.endswith("*") else 1 if len(term) < 8 else 2


class Neighbourhood:
    """Levenshtein automata of all terms over their trie, determinised as words ask for it."""

    def __init__(self, terms: list[str]):
        self.children, self.ends, self.sinks = [{}], [None], {}
        for term in terms:
            node = 0
            for letter in term.rstrip("*"):
                node = self.children[node].setdefault(letter, len(self.children))
                if node == len(self.ends):
                    self.children.append({})
                    self.ends.append(None)
            if term.endswith("*"):  # behind a stem anything may follow, which leads nowhere else
                self.sinks[node] = len(self.children)
                self.children.append({})
                self.ends.append(term)
            else:
                self.ends[node] = term
        self.absorbing = frozenset(self.sinks.values())
        self.most = max((edits_allowed(t) for t in terms), default=0)
        self.alphabet = frozenset("".join(terms))
        self.names, self.sets, self.moves, self.found = {}, [], [], []
        self.start = self._state({0: 0} if terms else {})

    def _state(self, reached: dict[int, int]) -> int:
        todo = list(reached)
        while todo:  # leaving out letters of the term costs an edit each
            node = todo.pop()
            if node in self.sinks:
                sink = self.sinks[node]
                reached[sink] = min(reached[node], reached.get(sink, self.most + 1))
            edits = reached[node] + 1
            if edits <= self.most:
                for child in self.children[node].values():
                    if edits < reached.get(child, self.most + 1):
                        reached[child] = edits
                        todo.append(child)
        name = frozenset(reached.items())
        if name not in self.names:
            self.names[name] = len(self.sets)
            ends = [(e, self.ends[n]) for n, e in reached.items()
                    if self.ends[n] and e <= edits_allowed(self.ends[n])]
            self.sets.append(reached)
            self.moves.append({})
            self.found.append(min(ends, default=None))
        return self.names[name]

    def _move(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}
        for node, edits in self.sets[state].items():
            stays = edits if node in self.absorbing else edits + 1  # elsewhere it is a letter too many
            if stays <= self.most:
                reached[node] = min(stays, reached.get(node, self.most + 1))
            for own, child in self.children[node].items():
                cost = edits + (own != letter)
                if cost <= self.most and cost < reached.get(child, self.most + 1):
                    reached[child] = cost
        return self._state(reached)

    def nearest(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term within its number of edits."""
        state = self.start
        for letter in word:
            letter = letter if letter in self.alphabet else ""
            following = self.moves[state].get(letter)
            if following is None:
                following = self.moves[state][letter] = self._move(state, letter)
            state = following
            if not self.sets[state]:
                return None
        return self.found[state]


FEATURES = 3


def _quoted(words: list[str], at: int) -> bool:
    """Whether the window around a word puts it between quotation marks or next to a reporting word."""
    before, after = words[max(0, at - WINDOW):at], words[at + 1:at + 1 + WINDOW]
    own = words[at]
    left = sum(w.count(m) for w in before for m in EITHER) + sum(own[:1].count(m) for m in EITHER)
    right = sum(w.count(m) for w in after for m in EITHER) + sum(own.rstrip(".,;:!?")[-1:].count(m) for m in EITHER)
    opened = any(m in w for w in [*before, own[:1]] for m in OPENING)
    closed = any(m in w for w in [own[1:], *after] for m in CLOSING)
    return (left % 2 == 1 and right > 0) or (opened and closed) or any(
        w.strip(EDGES) in REPORTING for w in (*before[-3:], *after[:3]))


class Reader:
    """Features of texts; remembers which words are no term's neighbour, up to a bounded number."""

    def __init__(self, lexicon: tuple[list[str], frozenset], remember: int = 300_000):
        terms, self.ordinary = lexicon
        self.near, self.remember = Neighbourhood(terms), remember
        self.clean: set[str] = set()
        self.hits: dict[str, int] = {}

    def _look_up(self, words: set[str]) -> None:
        if len(self.clean) + len(words) > self.remember:
            self.clean.clear()
        for word in words:
            core = word.strip(EDGES)
            hit = self.near.nearest(core)
            if hit and core not in self.ordinary:
                self.hits[word] = hit[0]
            else:
                self.clean.add(word)

    def features(self, text: str | None) -> list[float]:
        words = (text or "").lower().split()
        unknown = set(words) - self.clean
        if unknown:
            self._look_up(unknown - self.hits.keys())
        found = unknown & self.hits.keys()
        abuse, quoted = 0.0, 0
        if found:
            for at, word in enumerate(words):
                if word in found:
                    if _quoted(words, at):
                        quoted += 1
                    else:
                        abuse += EDIT_WORTH[self.hits[word]]
        if len(self.hits) > self.remember:
            self.hits.clear()
        return [math.log1p(abuse), math.log1p(quoted), 100.0 * abuse / (len(words) + 20)]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLD == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most about ``sample`` labelled rows, chosen by a hash of their id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    parts = 1 << 20
    share = min(parts, sample * parts // max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < share).select(
        F.col("doc_id").alias("labelled"), "toxic")
    return docs.select("doc_id", "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("text", "toxic")  # at most the sample


def _patterns(words: set[str]) -> set[str]:
    """The words and the stems they begin with."""
    stems = {w[:n] + "*" for w in words for n in range(*STEM) if len(w) >= n}
    return {w for w in words if len(w) >= 4} | stems


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by pattern and label, already summed within a batch."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
            counts[toxic.as_py()].update(_patterns({w.strip(EDGES) for w in (text.as_py() or "").lower().split()}))
        for toxic in (1, 0):
            seen = counts[toxic]
            there, zero = pa.array(seen.values(), pa.int64()), pa.array([0] * len(seen), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.string()), there if toxic else zero, zero if toxic else there],
                ["pattern", "toxic", "other"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every pattern with the word it stands for and that word's neighbours."""
    for batch in batches:
        seen = set()
        for text in batch.column("text"):
            words = [w.strip(EDGES) for w in (text.as_py() or "").lower().split()]
            for i, word in enumerate(words):
                for pattern in _patterns({word}):
                    seen.add((pattern, word, " ".join(words[max(0, i - 1):i] + words[i + 1:i + 2])))
        columns = zip(*seen, strict=True) if seen else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], ["pattern", "word", "context"])


def _chosen(found: dict[str, tuple[int, int, int]]) -> list[str]:
    """Terms out of (documents, neighbourhoods, words) by pattern: stems, and words that are no minor form of one."""
    stems = {p[:-1]: v for p, v in found.items() if p.endswith("*") and v[2] >= STEM_WORDS}
    starts = lambda w: [w[:n] for n in range(*STEM) if n <= len(w)]
    most = Counter()  # documents of a stem's most frequent longer stem
    for s, v in stems.items():
        for o in starts(s)[:-1]:
            most[o] = max(most[o], v[0])
    longest = {s for s, v in stems.items() if most[s] < 0.9 * v[0]}
    shortest = {s for s in longest if not any(o in longest for o in starts(s)[:-1])}
    covered = lambda w: max((stems[s][0] for s in starts(w) if s in shortest), default=0)
    words = [p for p, v in found.items() if not p.endswith("*") and 2 * v[0] >= covered(p)]
    return sorted([*(f"{s}*" for s in shortest), *words])


def _misspelt(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    near = Neighbourhood(terms)
    for batch in batches:
        hits = [(near.nearest(w.as_py()) or (0,))[0] > 0 for w in batch.column("pattern")]
        yield batch.filter(pa.array(hits, pa.bool_()))


def learn_lexicon(rows: DataFrame) -> tuple[list[str], frozenset]:
    """Patterns that set toxic rows apart, and the clean words that look like misspelt ones."""
    rows = written(rows.distinct(), "toxicity-texts")  # copies of a text are no further documents
    totals = rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    toxic, other = totals[0] or 0, totals[1] or 0
    if not toxic or not other:
        return [], frozenset()
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (other + 1))
    counted = written(rows.mapInArrow(_counts, "pattern string, toxic bigint, other bigint").groupBy("pattern").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).withColumn("odds", odds), "toxicity-counts")
    likely = written(counted.where((F.col("odds") >= LEAST_ODDS) & (F.col("toxic") >= LEAST_SUPPORT)).select(
        F.col("pattern").alias("wanted"), F.col("toxic").alias("documents")), "toxicity-likely")
    steady = (
        rows.where("toxic = 1").select("text").mapInArrow(_contexts, "pattern string, word string, context string")
        .join(likely, F.col("pattern") == F.col("wanted")).groupBy("pattern")
        .agg(F.first("documents").alias("documents"), F.countDistinct("context").alias("contexts"),
             F.countDistinct("word").alias("words"))
        .where(F.col("contexts") >= LEAST_SUPPORT)
        .collect())  # patterns of the sample's toxic texts, each in several of them
    chosen = _chosen({r["pattern"]: (r["documents"], r["contexts"], r["words"]) for r in steady})
    ordinary = counted.where("other > 0 and not endswith(pattern, '*')").select("pattern").mapInArrow(
        lambda b: _misspelt(b, chosen), "pattern string").collect()  # words within few edits of few terms
    return chosen, frozenset(r["pattern"] for r in ordinary)


def _feature_rows(batches: Iterator[pa.RecordBatch], lexicon: tuple) -> Iterator[pa.RecordBatch]:
    reader = Reader(lexicon)
    for batch in batches:
        rows = [reader.features(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "features"])


def fit(features: np.ndarray, toxic: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge; the last weight is the constant."""
    if not len(toxic) or toxic.min() == toxic.max():
        share = float(toxic.mean()) if len(toxic) else 0.0
        return np.r_[np.zeros(features.shape[1]), math.log((share + 1e-9) / (1 - share + 1e-9))]
    x = np.c_[features, np.ones(len(features))]
    weights = np.zeros(x.shape[1])
    pull = ridge * np.r_[np.ones(features.shape[1]), 0.0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9),
                               x.T @ (toxic - p) - pull * weights)
        weights += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return weights


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[tuple, np.ndarray]:
    """Lexicon and regression weights."""
    rows = written(training_rows(docs, labels, sample), "toxicity-sample")
    lexicon = learn_lexicon(rows)
    got = rows.mapInArrow(lambda b: _feature_rows(b, lexicon), "toxic int, features array<double>").toArrow()
    fitted = np.zeros((got.num_rows, FEATURES + 1))  # at most the sample, a few numbers a row
    fitted[:, 0] = got.column("toxic").to_numpy()
    fitted[:, 1:] = np.array(got.column("features").to_pylist(), float).reshape(got.num_rows, FEATURES)
    fitted = fitted[np.lexsort(fitted.T)]  # sums in one order, so that reruns agree
    return lexicon, fit(fitted[:, 1:], fitted[:, 0])


def _scores(batches: Iterator[pa.RecordBatch], lexicon: tuple, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    reader = Reader(lexicon)
    for batch in batches:
        rows = np.array([reader.features(t.as_py()) for t in batch.column("text")], float).reshape(-1, FEATURES)
        score = 1 / (1 + np.exp(-np.clip(rows @ weights[:-1] + weights[-1], -700, 700)))
        rest = [batch.column(n) for n in batch.schema.names if n != "text"]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(score)], [*names, "score"])


def scored(docs: DataFrame, model: tuple[tuple, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    lexicon, weights = model
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(
        lambda b: _scores(b, lexicon, weights), f"doc_id {kind}, score double")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _kept(batches: Iterator[pa.RecordBatch], lexicon: tuple, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    reader = Reader(lexicon)
    for batch in batches:
        rows = np.array([reader.features(t.as_py()) for t in batch.column("text")], float).reshape(-1, FEATURES)
        yield batch.filter(pa.array(rows @ weights[:-1] + weights[-1] < 0))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents scored below one half, with all their columns."""
    lexicon, weights = learn(docs, labels, sample)
    return docs.mapInArrow(lambda b: _kept(b, lexicon, weights), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
