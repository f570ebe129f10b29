"""Scores of texts under a log-bilinear language model trained by noise-contrastive estimation.

A position's prediction is the sum of the vectors of the ``CONTEXT`` words before it, each weighted place by place by a vector of
its distance; a target's score is the product of the prediction with the target's vector, plus the target's bias. Targets are
the ``SINGLE`` most frequent tokens and ``SHARED`` classes of all others, by the words' endings; within a class a word has its
share of the class's training tokens, one unseen word included. So probabilities of all words sum to one, and a
batch of contexts is normalised by one matrix product over the targets. A task splits, counts and numbers words by Arrow, some
hundred texts at once, and normalises a context that several of their positions share only once.

Training is numpy in tasks over every training text: each task runs through its texts by minibatches that share ``NOISE`` draws from
the targets' frequencies, and returns how far it moved each row; moves are averaged by row, weighted by use. A first round
over one text in ``OPENING`` sets out, a second one reads all. The network's size is fixed by the parameters below. The
counts of words, which make the shares, the biases and the base score, are of the whole corpus and grow with it: rare words
meet their counts in a join, only those of the ``COUNTED`` most frequent are sent to tasks.

Defined results. Words are split at ASCII space and lowered in ASCII; NULL and empty texts are the end alone. A row
without an id is not held out. Repeated rows are scored each, and count each. Equally frequent words go by their bytes. Contexts are
normalised in blocks of ``ROWS``. An empty table gives an empty result; if no text is for training, all words are
unseen. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, partitions, table, written

CONTEXT = 2
WIDTH = 16
SINGLE = 256
SHARED = 64
KNOWN = 4096  # tokens with an input vector of their own
COUNTED = 1 << 15  # tokens whose counts tasks have at hand
ENDINGS = 256  # input vectors that all other words share by their endings
NOISE = 32
RATE = 0.05
OPENING = 16
ROWS = 512
BATCH = 2048
FOLDS = 10
END = b"\n"  # no word holds a line break
PLUS = 0.1  # what an unseen token counts
SAFE = 60.0  # exp of so much, and a sum of them, is well within single precision
GATHER = 1 << 19  # words that a counting task holds before it passes them on
PART = 1 << 21  # bytes of text that a task splits at once, or one text
PADDING = KNOWN + ENDINGS  # the input row before a text's first word


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of texts that ``PART`` bytes hold; a longer text is alone."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + PART, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many tokens each text has: its words and its end."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, text_of = split.flatten(), pc.list_parent_indices(split)
    full = pc.greater(pc.binary_length(words), 0)
    length = np.bincount(text_of.filter(full).to_numpy(), minlength=len(texts)) + 1
    return words.filter(full).cast(pa.binary()), length


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


@dataclass
class Model:
    words: dict[bytes, tuple[int, int]]  # known token: its place by frequency, its count
    base: float  # the base score's denominator
    frequency: np.ndarray  # of targets
    vectors: np.ndarray  # of input rows
    distances: np.ndarray
    targets: np.ndarray
    bias: np.ndarray

    def row(self, word: bytes) -> int:
        known = self.words.get(word)
        return known[0] if known and known[0] < KNOWN else KNOWN + ending(word)

    def target(self, word: bytes) -> int:
        row = self.row(word)
        return row if row < SINGLE else SINGLE + ending(word) % SHARED


def _endings(words: pa.Array, at: np.ndarray) -> np.ndarray:
    """``ending`` of the words at these places, once for each two last bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    end, size = offsets[1:][at], (offsets[1:] - offsets[:-1])[at]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    pair = np.where(size > 1, data[end - 2].astype(np.int32) << 8, 1 << 16) | data[end - 1]
    met = np.flatnonzero(np.bincount(pair))
    found = np.zeros(met.max(initial=0) + 1, np.int32)
    for code in met.tolist():
        found[code] = ending(code.to_bytes(3)[1 if code < 1 << 16 else 2:])
    return found[pair]


class _Codes:
    """A number for every token: its place among the counted ones, or behind them one that words of an ending share."""

    def __init__(self, model: Model):
        self.words = pa.array(sorted(model.words, key=lambda word: model.words[word][0]), pa.binary())
        self.end = model.words[END][0]
        place, rest = np.arange(len(self.words)), np.arange(ENDINGS)
        own = _endings(self.words, place)
        self.row = np.r_[np.zeros(COUNTED, np.int32), KNOWN + rest].astype(np.int32)
        self.target = np.r_[np.zeros(COUNTED, np.int32), SINGLE + rest % SHARED].astype(np.int32)
        self.row[place] = np.where(place < KNOWN, place, KNOWN + own)
        self.target[place] = np.where(place < SINGLE, place, SINGLE + own % SHARED)

    def of(self, words: pa.Array) -> np.ndarray:
        code = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        rare = np.flatnonzero(code < 0)
        if len(rare):
            code[rare] = COUNTED + _endings(words, rare)
        return code


def _merged(held: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    waiting = ends = 0
    for batch in batches:
        for part in _parts(batch):
            words, length = _words(part.column("text"))
            ends += len(length)
            own = pc.value_counts(words)
            held.append(pa.table([own.field("values"), own.field("counts")], ["word", "c"]))
            waiting += len(own)
            if waiting >= GATHER:
                held = [_merged(held)]
                waiting = held[0].num_rows
            if waiting >= GATHER // 2 and len(held) == 1:
                yield from held[0].combine_chunks().to_batches()
                held, waiting = [], 0
    if ends:
        held.append(pa.table([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], ["word", "c"]))
        yield from _merged(held).combine_chunks().to_batches()


def split(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, text)"""
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    return docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text")


def _sequences(batch: pa.RecordBatch, ids: _Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Code, context rows and target of every position of a batch's texts, the texts' lengths, and all words but the ends."""
    words, length = _words(batch.column("text"))
    ends = np.cumsum(length)
    code = np.full(ends[-1] if len(ends) else 0, ids.end, np.int32)
    inside = np.ones(len(code), bool)
    inside[ends - 1] = False
    code[inside] = ids.of(words)
    row, starts = ids.row[code], ends - length
    context = np.full((len(row), CONTEXT), PADDING, np.int32)
    for j in range(CONTEXT):
        context[j + 1:, j] = row[:-j - 1]
        for k in range(j + 1):  # the first words of a text have none so far before them
            context[starts[length > k] + k, j] = PADDING
    return code, context, ids.target[code], length, words


def _predicted(model: Model, context: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(context), WIDTH), np.float32)
    for j in range(CONTEXT):
        out += vectors[context[:, j]] * model.distances[j]
    return out


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different rows, the sums of their values, and how many there are of each."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    ordered = rows[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[starts], np.add.reduceat(values.take(order, axis=0), starts, axis=0), np.diff(np.r_[starts, len(rows)])


class _Trainer:
    """Stochastic gradient steps on a task's own copy of the model, with a step size that falls row by row."""

    def __init__(self, model: Model):
        self.model = model
        # one matrix of all that is learnt: inputs, the padding's row, distances, targets; and a column of biases
        self.first = len(model.vectors), len(model.vectors) + CONTEXT
        self.all = np.vstack([model.vectors, model.distances, model.targets]).astype(np.float32)
        self.bias = model.bias.astype(np.float32).copy()
        self.start, self.start_bias = self.all.copy(), self.bias.copy()
        self.used = np.zeros(len(self.all), np.int64)
        self.seen = np.full(len(self.all), 1e-3, np.float32)
        self.seen_bias = np.full(len(self.bias), 1e-3, np.float32)
        self.offset = np.log(NOISE * model.frequency).astype(np.float32)
        self.random = np.random.default_rng(42)
        self.cumulated = np.cumsum(model.frequency)

    def _move(self, rows: np.ndarray, gradient: np.ndarray, counts: np.ndarray) -> None:
        gradient = gradient / np.sqrt(np.maximum(counts, 1)).astype(np.float32)[:, None]
        self.seen[rows] += np.square(gradient).mean(axis=1)
        self.all[rows] += RATE * gradient / np.sqrt(self.seen[rows])[:, None]
        self.used[rows] += counts

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        inputs, places = self.first
        vectors, distances, targets = self.all[:inputs], self.all[inputs:places], self.all[places:]
        noise = np.minimum(np.searchsorted(self.cumulated, self.random.random(NOISE) * self.cumulated[-1]), len(targets) - 1)
        own = [vectors.take(context[:, j], axis=0) for j in range(CONTEXT)]
        chosen, drawn = targets.take(target, axis=0), targets[noise]
        guess = sum(own[j] * distances[j] for j in range(CONTEXT))
        with np.errstate(over="ignore"):
            right = 1 / (1 + np.exp(np.einsum("ij,ij->i", guess, chosen) + (self.bias - self.offset)[target]))
            wrong = -1 / (1 + np.exp((self.offset - self.bias)[noise] - guess @ drawn.T))
        back = right[:, None] * chosen + wrong @ drawn
        to_distances = np.stack([np.einsum("ij,ij->j", back, own[j]) for j in range(CONTEXT)])
        to_vectors = np.vstack([back * distances[j] for j in range(CONTEXT)])
        moved = np.r_[target, noise]
        gradient = np.vstack([right[:, None] * guess, wrong.T @ guess])
        to_bias = np.bincount(moved, np.r_[right, wrong.sum(axis=0)], len(targets)).astype(np.float32)
        rows, sums, counts = _summed(context.T.ravel(), to_vectors)
        self._move(rows, sums, counts)
        self._move(np.arange(inputs, places), to_distances, np.full(CONTEXT, len(target)))
        rows, sums, counts = _summed(moved, gradient)
        self._move(places + rows, sums, counts)
        step = to_bias[rows] / np.float32(np.sqrt(len(target)))
        self.seen_bias[rows] += np.square(step)
        self.bias[rows] += RATE * step / np.sqrt(self.seen_bias[rows])

    def moves(self, task: int) -> pa.RecordBatch:
        """How far each used row has moved, times its uses; a target's row has its bias behind it."""
        places = self.first[1]
        shift = np.hstack([self.all - self.start, np.zeros((len(self.all), 1), np.float32)])
        shift[places:, -1] = self.bias - self.start_bias
        rows = np.flatnonzero(self.used)
        weighted = shift[rows].astype(np.float64) * self.used[rows][:, None]
        return pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int32()), pa.array(np.full(len(rows), task), pa.int32()), pa.array(self.used[rows]),
             pa.array(list(weighted), pa.list_(pa.float64()))], ["row", "task", "used", "shift"])


def _trained(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    trainer, ids = _Trainer(model), _Codes(model)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for batch in batches:
        for texts in _parts(batch):
            _, context, target, *_ = _sequences(texts, ids)
            held.append((context, target))
            waiting += len(target)
            if waiting < 8 * BATCH:
                continue
            context, target = (np.concatenate(x) for x in zip(*held, strict=True))
            order = trainer.random.permutation(len(target))
            for start in range(0, len(order) - BATCH + 1, BATCH):
                part = order[start:start + BATCH]
                trainer.step(context[part], target[part])
            rest = order[len(order) - len(order) % BATCH:]
            held, waiting = [(context[rest], target[rest])], len(rest)
    if waiting:
        context, target = (np.concatenate(x) for x in zip(*held, strict=True))
        for start in range(0, len(target), BATCH):
            trainer.step(context[start:start + BATCH], target[start:start + BATCH])
    if trainer.used.any():
        yield trainer.moves(TaskContext.get().partitionId())


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean move of every row that reaches this task; rows are as many as the network has."""
    used: Counter = Counter()
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, n, shift in zip(*[batch.column(c).to_pylist() for c in ("row", "used", "shift")], strict=True):
            used[row] += n
            total[row] = total.get(row, 0) + np.array(shift)
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([list(v / used[k]) for k, v in total.items()], pa.list_(pa.float64()))],
            ["row", "shift"])


def _round(model: Model, texts: DataFrame) -> None:
    """Train on all of ``texts`` and move the model."""
    moves = written(texts.mapInArrow(
        lambda batches: _trained(batches, model), "row int, task int, used bigint, shift array<double>"), "moves")
    spark = texts.sparkSession
    mean = moves.repartition(partitions(spark), "row").sortWithinPartitions("row", "task").mapInArrow(
        _averaged, "row int, shift array<double>").toArrow()  # a row for each of the network's
    inputs, places = len(model.vectors), len(model.vectors) + CONTEXT
    for row, shift in zip(mean.column("row").to_pylist(), mean.column("shift").to_pylist(), strict=True):
        move = np.array(shift, np.float32)
        if row < inputs:
            model.vectors[row] += move[:WIDTH]
        elif row < places:
            model.distances[row - inputs] += move[:WIDTH]
        else:
            model.targets[row - places] += move[:WIDTH]
            model.bias[row - places] += move[WIDTH]
    discard(moves)


@dataclass
class Trained:
    model: Model
    counts: DataFrame  # (word, c, target) of all training tokens that tasks do not know
    tokens: int
    shares: list[float]  # by shared class: tokens and the share of unseen words


def _frequent(counted: DataFrame) -> list[tuple[bytes, int]]:
    """The end and the most frequent words, ``COUNTED`` at most, in order. Counts are told apart by eighths of an
    octave first, so that no more than these words reach the driver, however many tasks there are."""
    rank = F.floor(8 * F.log2("c")).cast("int")
    sizes = dict(counted.groupBy(rank.alias("rank")).count().collect())  # a row an eighth, some hundreds
    least, held = max(sizes, default=0) + 1, 1
    for own in sorted(sizes, reverse=True):
        held += sizes[own]
        if held > COUNTED:
            break
        least = own
    found = [(bytes(r.word), r.c) for r in counted.where((rank >= least) | (F.col("word") == END)).collect()]
    return sorted(found, key=lambda x: (x[0] != END, -x[1], x[0]))


def learn(docs: DataFrame) -> Trained:
    """Count all training tokens, then train the network on all training texts."""
    training = split(docs).where("not held_out").select("text")
    counted = written(training.mapInArrow(_counts, "word binary, c bigint").groupBy("word").agg(
        F.sum("c").alias("c")), "counts")
    n, v = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = {word: (i, c) for i, (word, c) in enumerate(_frequent(counted))}
    words.setdefault(END, (0, 0))
    random = np.random.default_rng(1)
    model = Model(words, n + PLUS * (v + 1), np.zeros(SINGLE + SHARED),
                  random.normal(0, 0.1, (KNOWN + ENDINGS + 1, WIDTH)).astype(np.float32),
                  np.full((CONTEXT, WIDTH), 1 / CONTEXT, np.float32),
                  random.normal(0, 0.1, (SINGLE + SHARED, WIDTH)).astype(np.float32), np.zeros(SINGLE + SHARED, np.float32))
    model.vectors[PADDING] = 0  # before a text's first word

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Codes(model)
        for batch in batches:
            target = ids.target[ids.of(batch.column("word"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(target)], ["word", "c", "target"])

    classed = written(counted.mapInArrow(classes, "word binary, c bigint, target int"), "classed")
    sums = {r.target: (r.c, r.v) for r in classed.groupBy("target").agg(
        F.sum("c").alias("c"), F.count("*").alias("v")).collect()}  # a row a target
    for target in range(SINGLE + SHARED):
        model.frequency[target] = sums.get(target, (0, 0))[0] + PLUS
    model.frequency /= model.frequency.sum()
    model.bias[:] = np.log(model.frequency)
    shares = [sums.get(SINGLE + k, (0, 0))[0] + PLUS * (sums.get(SINGLE + k, (0, 0))[1] + 1) for k in range(SHARED)]
    discard(counted)
    if n:
        _round(model, training.where(F.pmod(F.xxhash64("text"), F.lit(OPENING)) == 0))
        _round(model, training)
    return Trained(model, classed, n, shares)


def _network(model: Model, with_bias: np.ndarray, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log10 of the targets' probabilities; a context that several positions share is normalised once."""
    pair, place = np.unique(context @ (PADDING + 1) ** np.arange(CONTEXT), return_inverse=True)
    context = np.stack([pair // (PADDING + 1) ** j % (PADDING + 1) for j in range(CONTEXT)], axis=1)
    guess = np.ones((len(pair), WIDTH + 1), np.float32)  # the last place is the bias's
    norm = np.empty(len(pair), np.float32)
    room, ones = np.empty((ROWS, with_bias.shape[1]), np.float32), np.ones(with_bias.shape[1], np.float32)
    for start in range(0, len(pair), ROWS):
        part = slice(start, start + ROWS)
        guess[part, :WIDTH] = _predicted(model, context[part], model.vectors)
        score = np.matmul(guess[part], with_bias, out=room[:len(guess[part])])
        high = score.max()
        if max(high, -score.min()) > SAFE:  # exp would leave its range
            high = score.max(axis=1)
            score -= high[:, None]
        else:
            high = 0
        np.exp(score, out=score)
        norm[part] = high + np.log(score @ ones)
    out, of_target = np.empty(len(target)), np.ascontiguousarray(with_bias.T)
    for start in range(0, len(target), 16 * ROWS):
        part = slice(start, start + 16 * ROWS)
        own = np.einsum("ij,ij->i", guess.take(place[part], axis=0), of_target.take(target[part], axis=0))
        out[part] = (own - norm[place[part]]) / math.log(10)
    return out


def _scored(batches: Iterator[pa.RecordBatch], model: Model, in_class: list[float]) -> Iterator[pa.RecordBatch]:
    """Per text: what the network and the known words' counts give, and its rare words."""
    task, number = TaskContext.get().partitionId(), 0
    ids, log_base = _Codes(model), math.log10(model.base)
    count = np.zeros(COUNTED + ENDINGS)
    for place, c in model.words.values():
        count[place] = c
    log_c = np.log10(count + PLUS)
    to_base, known = log_c - log_base, count > 0
    to_share = np.where(ids.target < SINGLE, 0.0, log_c - np.log10(in_class)[np.maximum(ids.target - SINGLE, 0)])
    to_base[COUNTED:] = to_share[COUNTED:] = 0  # those wait for their counts
    with_bias = np.vstack([model.targets.T, model.bias]).astype(np.float32)
    for whole in batches:
        for batch in _parts(whole):
            codes, context, target, length, words = _sequences(batch, ids)
            log_p = to_share[codes]
            for start in range(0, len(target), PART // 4):  # more than one only within a text longer than ``PART``
                run = slice(start, start + PART // 4)
                log_p[run] += _network(model, with_bias, context[run], target[run])
            starts = np.cumsum(length) - length
            network, base, n_known = (np.add.reduceat(x, starts) for x in (log_p, to_base[codes], known[codes].astype(np.int64)))
            far = np.flatnonzero(codes >= COUNTED)
            text_of = np.repeat(np.arange(len(length)), length)[far]
            own = words.take(pa.array(far - text_of)).dictionary_encode()  # a text's words come behind as many ends
            _, first, times = np.unique(text_of * len(own.dictionary) + own.indices.to_numpy(), return_index=True, return_counts=True)
            offsets = np.r_[0, np.cumsum(np.bincount(text_of[first], minlength=len(length)))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
                [own.dictionary.take(own.indices.take(pa.array(first))), pa.array(times, pa.int32()),
                 pa.array(target[far[first]] - SINGLE, pa.int32())], ["word", "times", "shared"]))
            names = (task << 33) + number + np.arange(len(length))
            number += len(length)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(length), pa.array(n_known),
                 pa.array(base), pa.array(network), lists],
                ["doc_id", "held_out", "name", "n_tokens", "n_known", "base", "score", "rare"])


def scored(docs: DataFrame, trained: Trained) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text."""
    texts, model, in_class = split(docs), trained.model, trained.shares
    kind = texts.schema["doc_id"].dataType.simpleString()
    parts = written(texts.mapInArrow(
        lambda batches: _scored(batches, model, in_class),
        f"doc_id {kind}, held_out boolean, name bigint, n_tokens bigint, n_known bigint, base double, score double, "
        "rare array<struct<word: binary, times: int, shared: int>>"), "parts")
    share = F.element_at(F.array(*[F.lit(math.log10(s)) for s in trained.shares]), F.col("shared") + 1)
    log_c = F.log10(F.coalesce("c", F.lit(0)) + F.lit(PLUS))
    rare = (parts.select("name", F.explode("rare").alias("r")).select("name", "r.word", "r.times", "r.shared")
            .join(trained.counts.select("word", "c"), "word", "left")
            .groupBy("name").agg(
                F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
                F.sum(F.col("times") * (log_c - F.lit(math.log10(trained.model.base)))).alias("rare_base"),
                F.sum(F.col("times") * (log_c - share)).alias("rare_share")))
    rare = written(rare, "rare")
    return parts.select("doc_id", "held_out", "name", "n_tokens", "n_known", "base", "score").join(rare, "name", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(trained.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_share", F.lit(0.0))).alias("score"))


def op11_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, learn(docs))
