"""Substring deduplication: words under a window that an earlier document also holds.

A window is ``window`` consecutive words. Candidates come first and lose nothing: among the hashes
of all runs of ``GRAM`` words the smallest of every ``SPREAD`` neighbours is an anchor; a window that occurs twice
has the same anchors in both places, so only windows whose anchors all occur in two documents or more can repeat.
Neighbouring candidate windows whose smallest hash is the same form a passage, and passages are
sent to shards by that hash, which puts equal windows into one shard. Each shard builds a
compressed FM-index over blocks of its passages; backward search gives how far each window's end
matches to the left in an earlier document, and what is at least a window long is reported as an interval.

Equal passages are folded first: their words leave a map task once, the earliest document that holds them is found by
partial aggregation, and every later holder loses the passage whole. An index is built over the different passages only,
and what it finds in one holds for all rows of it. A shard with more than ``SPLIT`` different passages is cut again, by the
``LEAST`` smallest hashes of each window, and one that is still larger into its single windows, of which equal ones
fold: no shard grows with the documents, and none is searched in another way.

Exact copies of a document are set aside before: all but the first lose every word if they have a
window at all.

Defined results. NULL and empty texts have no words. A NULL id sorts behind all others, and rows without an id do not
remove from one another; nor do rows repeating an id. Windows are judged on the input. A text is split whole in one
task, however long, with 8 bytes a word beside it. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, row_key, table, written
from tidemark.llm.fmindex import FMIndex

WINDOW = 50
GRAM = 8
SPREAD = 16
SPLIT = 1024  # different passages of a shard before it is cut finer
LEAST = 4  # hashes of a window that name its shard in the first finer cut
REMEMBER = 1 << 18  # passages whose words a task remembers having sent
WIDE = 1 << 14  # windows whose hashes are sorted at once
BLOCK_WORDS = 1 << 20  # words that one index holds
BATCH_BYTES = 1 << 24
LAST = (1 << 63) - 1  # the place of a NULL id in the order of documents
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _grams(words: list[bytes], gram: int) -> np.ndarray:
    """A mixed hash of every run of ``gram`` words."""
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(w) for w in words], np.uint64, len(words))
    size = len(words) - gram + 1
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(gram):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + size]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    out, have = values, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return np.minimum(out[:len(out) - (width - have)], out[width - have:]) if have < width else out


def _anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        counts, digests, anchors = [], [], []
        for text in batch.column("text"):
            words = _words(text.as_py())
            counts.append(len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            found = np.zeros(0, np.uint64)
            if len(words) >= window:
                found = np.unique(_lowest(_grams(words, GRAM), SPREAD))
            anchors.append(found.view(np.int64))
        offsets = np.r_[0, np.cumsum([len(a) for a in anchors])].astype(np.int32)
        values = np.concatenate([*anchors, np.zeros(0, np.int64)])
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in rest], pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], [*rest, "n_words", "sha", "anchors"])


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, int(batch.num_rows * BATCH_BYTES / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def candidate_windows(grams: np.ndarray, shared: np.ndarray, window: int) -> np.ndarray:
    """Whether each window's anchors are all shared; only anchors that the window alone determines count."""
    fine = np.isin(_lowest(grams, SPREAD).view(np.int64), shared)
    inside = window - GRAM - SPREAD + 2  # spreads of grams that lie wholly in a window
    run = np.r_[0, np.cumsum(fine)]
    return run[inside:] - run[:-inside] == inside


PASSAGES = ("shard bigint, w1 bigint, w2 bigint, place bigint, r1 bigint, r2 bigint, first bigint, n bigint, "
            "words binary")


class _Pieces:
    """Passages as rows; their words go along where the task has not sent them with as small a place."""

    def __init__(self) -> None:
        self.lowest: dict[bytes, int] = {}
        self.rows: list[tuple] = []

    def add(self, shard: int, place: int, row: tuple[int, int], first: int, words: list[bytes]) -> None:
        joined = b" ".join(words)
        digest = xxhash.xxh3_128_digest(joined)
        known = self.lowest.get(digest)
        if known is not None and known <= place:
            joined = None
        else:
            if len(self.lowest) >= REMEMBER:
                self.lowest.clear()
            self.lowest[digest] = place
        name = np.frombuffer(digest, np.int64)
        self.rows.append((shard, int(name[0]), int(name[1]), place, *row, first, len(words), joined))

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else ((),) * 9
        self.rows = []
        kinds = [pa.int64()] * 8 + [pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["shard", "w1", "w2", "place", "r1", "r2", "first", "n", "words"])


def _edges(*changed: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.logical_or.reduce(changed)) + 1


def _passages(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    pieces = _Pieces()
    for batch in _small(batches):
        columns = [batch.column(c) for c in ("text", "shared", "place", "rid")]
        for text, shared, place, rid in zip(*columns, strict=True):
            words = _words(text.as_py())
            grams = _grams(words, GRAM)
            starts = np.flatnonzero(candidate_windows(grams, shared.values.to_numpy(), window))
            if not len(starts):
                continue
            key = _lowest(grams, window - GRAM + 1).view(np.int64)[starts]
            edges = _edges(np.diff(starts) != 1, np.diff(key) != 0)
            for a, b in zip(np.r_[0, edges], np.r_[edges, len(starts)], strict=True):
                first, stop = int(starts[a]), int(starts[b - 1]) + window
                pieces.add(int(key[a]), place.as_py(), (rid.as_py(), 0), first, words[first:stop])
        yield pieces.batch()


def smallest_mixed(grams: np.ndarray, width: int, least: int) -> np.ndarray:
    """A hash of the ``least`` smallest of every ``width`` neighbours."""
    out = np.zeros(len(grams) - width + 1, np.uint64)
    for a in range(0, len(out), WIDE):
        view = np.lib.stride_tricks.sliding_window_view(grams[a:a + WIDE + width - 1], width)
        kept = np.sort(np.partition(view, least - 1, axis=1)[:, :least], axis=1)
        with np.errstate(over="ignore"):
            for column in kept.T:
                out[a:a + WIDE] = (out[a:a + WIDE] ^ column) * np.uint64(0x9E3779B97F4A7C15)
                out[a:a + WIDE] ^= out[a:a + WIDE] >> np.uint64(29)
    return out


def _recut(batches: Iterator[pa.RecordBatch], window: int, single: bool) -> Iterator[pa.RecordBatch]:
    """Passages (w1, w2, place, words) cut where the smallest hashes of their windows change, or into single windows."""
    pieces = _Pieces()
    for batch in _small(batches):
        columns = [batch.column(c) for c in ("w1", "w2", "place", "words")]
        for w1, w2, place, joined in zip(*columns, strict=True):
            words = joined.as_py().split(b" ")
            count = len(words) - window + 1
            if single:
                edges, key = np.arange(1, count), np.zeros(count, np.int64)
            else:
                key = smallest_mixed(_grams(words, GRAM), window - GRAM + 1, LEAST).view(np.int64)
                edges = _edges(np.diff(key) != 0)
            for a, b in zip(np.r_[0, edges].tolist(), np.r_[edges, count].tolist(), strict=True):
                part = words[a:b - 1 + window]
                shard = xxhash.xxh3_64_intdigest(b" ".join(part)) - (1 << 63) if single else int(key[a])
                pieces.add(shard, place.as_py(), (w1.as_py(), w2.as_py()), a, part)
        yield pieces.batch()


def matched_windows(index: FMIndex, text: np.ndarray, begin: np.ndarray, count: np.ndarray, owner: np.ndarray,
                    window: int) -> np.ndarray:
    """Which windows of the passages occur with a smaller owner, as flags by their first word.

    A range of undecided windows is tried at its right end: the match found there reaches left and
    decides every window in it. Where it falls short, the left end is tried, whose shortfall rules out all
    windows up to the mismatch; ranges good on the left and bad on the right are halved.
    """
    good = np.zeros(len(text) + 1, np.int32)  # +1 where a run of good windows begins, -1 behind it
    first, last, own = begin.copy(), begin + count - 1, owner.copy()
    from_right = np.ones(len(begin), bool)
    while len(first):
        right = np.flatnonzero(from_right)
        left = np.flatnonzero(~from_right)
        end = np.where(from_right, last, first) + window
        reach = index.reach(text, end, first, own)
        following = []
        # From the right: windows from where the match begins up to the last one are good.
        start, a, b = reach[right], first[right], last[right]
        hit = start <= b
        np.add.at(good, start[hit], 1)
        np.add.at(good, b[hit] + 1, -1)
        rest = np.where(hit, start, b) - 1  # the last window not decided
        more = rest >= a
        following.append((a[more], rest[more], own[right][more], np.zeros(int(more.sum()), bool)))
        # From the left: a mismatch before the window's start is none; else it rules windows out.
        start, a, b = reach[left], first[left], last[left]
        hit = start <= a
        np.add.at(good, a[hit], 1)
        np.add.at(good, a[hit] + 1, -1)
        a, b, o = np.where(hit, a + 1, start), b, own[left]
        middle = (a + b) // 2
        for lo, hi, which, way in ((a, b, ~hit, False), (a, middle, hit, True), (middle + 1, b, hit, False)):
            keep = which & (lo <= hi)
            following.append((lo[keep], hi[keep], o[keep], np.full(int(keep.sum()), way)))
        first, last, own, from_right = (np.concatenate(c) for c in zip(*following, strict=True))
    return np.cumsum(good[:-1]) > 0


def _block_spans(rows: list[tuple], window: int) -> list[tuple[int, int, int, int]]:
    """(w1, w2, first word, word behind the last) of the windows of different passages (w1, w2, place, words) that one
    with a smaller place holds."""
    split = [row[3].split(b" ") for row in rows]
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(words) for words in split])
    flat = np.fromiter([numbers.setdefault(w, len(numbers)) for words in split for w in words], np.int64, int(sizes.sum()))
    passage = np.repeat(np.arange(len(split)), sizes)
    twice = np.bincount(np.unique(np.stack([flat, passage]), axis=1)[0], minlength=len(numbers)) > 1
    symbols = np.where(twice, np.cumsum(twice), 0)  # a word of one passage only can match nothing: an end
    begin = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    text = np.zeros(int(sizes.sum()) + len(split), np.int64)
    text[np.arange(len(flat)) + passage] = symbols[flat]
    places = np.unique([row[2] for row in rows], return_inverse=True)[1].astype(np.int32)
    owner = np.repeat(places, sizes + 1)
    index = FMIndex(text, owner, int(symbols.max()) + 1)
    good = matched_windows(index, text, begin, sizes - window + 1, places, window)
    edges = np.diff(np.r_[False, good, False].astype(np.int8))
    spans = []
    for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
        which = int(np.searchsorted(begin, a, "right")) - 1
        spans.append((*rows[which][:2], int(a - begin[which]), int(b - 1 - begin[which]) + window))
    return spans


def _spans(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Blocks of whole shards out of a partition that lies by shard, passage and place."""
    def found(rows: list[tuple]) -> pa.RecordBatch:
        spans = _block_spans(rows, window) if rows else []
        columns = zip(*spans, strict=True) if spans else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["w1", "w2", "first", "stop"])

    held, own, size, shard = [], [], 0, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("shard", "w1", "w2", "place", "words")]
        for row in zip(*columns, strict=True):
            if row[0] != shard:
                if len(own) > 1:
                    held += own
                    size += sum(len(r[3]) for r in own) // 6
                shard, own = row[0], []
                if size >= BLOCK_WORDS:
                    yield found(held)
                    held, size = [], 0
            if not own or own[-1][:2] != row[1:3]:  # another task may have sent the same words, with a greater place
                own.append(row[1:])
    yield found(held + own if len(own) > 1 else held)


def repeated_spans(passages: DataFrame, window: int, split: int, cuts: tuple[bool, ...] = (False, True)) -> DataFrame:
    """(r1, r2, first, stop) word ranges of the written passages that a smaller place also holds.

    ``cuts`` are the finer cuts that are left for shards over ``split``; behind the last a shard is one window.
    """
    kinds = written(passages.groupBy("shard", "w1", "w2").agg(
        F.min("place").alias("lowest"), F.max("place").alias("highest")), "kinds")
    shards = written(kinds.groupBy("shard").agg(
        F.count("*").alias("kinds"), F.min("lowest").alias("a"), F.max("lowest").alias("b")).where(
            "a < b").select("shard", (F.col("kinds") > split).alias("large")), "shards")
    texts = passages.where("words is not null").select("shard", "w1", "w2", "place", "words").join(shards, "shard")
    large = bool(cuts) and not shards.where("large").isEmpty()
    spans = (texts.where("not large") if large else texts).drop("large").repartition("shard").sortWithinPartitions(
        "shard", "w1", "w2", "place").mapInArrow(lambda b: _spans(b, window), "w1 bigint, w2 bigint, first bigint, stop bigint")
    if large:
        each = texts.where("large").groupBy("shard", "w1", "w2").agg(
            F.min_by("words", "place").alias("words"), F.min("place").alias("place"))
        single = cuts[0]
        pieces = written(each.mapInArrow(lambda b: _recut(b, window, single), PASSAGES), "pieces")
        spans = spans.unionAll(repeated_spans(pieces, window, split, cuts[1:]))
    found = written(spans.groupBy("w1", "w2").agg(F.collect_list(F.struct("first", "stop")).alias("spans")), "found")
    verdicts = kinds.join(found, ["w1", "w2"], "left").where("lowest < highest or spans is not null").select(
        "w1", "w2", "lowest", F.coalesce("spans", F.expr("array()")).alias("spans"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n").alias("stop")))
    own = F.explode(F.when(F.col("place") > F.col("lowest"), whole).otherwise(F.col("spans"))).alias("own")
    return passages.drop("words", "shard").join(verdicts, ["w1", "w2"]).select("r1", "r2", "first", own).select(
        "r1", "r2", (F.col("first") + F.col("own.first")).alias("first"), (F.col("first") + F.col("own.stop")).alias("stop"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        removed, kept = [], []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            words = _words(text.as_py())
            stay = np.ones(len(words), bool)
            for span in spans:
                stay[span["first"]:span["stop"]] = False
            removed.append(int(len(words) - stay.sum()))
            kept.append(b" ".join([words[i] for i in np.flatnonzero(stay)]).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            ["rid", "n_removed", "kept"])


def deduplicated(docs: DataFrame, window: int = WINDOW, split: int = SPLIT) -> DataFrame:
    """Per row of (doc_id, text): n_words, n_removed, kept_sha256, and the kept text where it differs from all words."""
    keyed = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("place"),
        row_key(F.col("doc_id"), F.col("text")).alias("rid"), F.xxhash64("text").alias("c1"),
        F.xxhash64(F.lit(1), "text").alias("c2"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = written(keyed.mapInArrow(
        lambda b: _anchors(b, window), f"doc_id {kind}, place bigint, rid bigint, c1 bigint, c2 bigint, "
        "n_words bigint, sha string, anchors array<bigint>"), "anchors")
    firsts = written(read.groupBy("c1", "c2").agg(F.min("place").alias("lowest"), F.count("*").alias("rows"))
                     .where("rows > 1").drop("rows"), "copies")
    rows = read.join(firsts, ["c1", "c2"], "left").withColumn(
        "copy", F.coalesce(F.col("place") > F.col("lowest"), F.lit(False)))
    held = written(rows.where("not copy").select("place", "rid", F.explode("anchors").alias("anchor")).distinct(), "held")
    shared = written(held.groupBy("anchor").agg(F.min("place").alias("a"), F.max("place").alias("b"))
                     .where("a < b").select("anchor"), "shared")
    lists = held.join(shared, "anchor").groupBy("rid").agg(  # at most a document's anchors
        F.first("place").alias("place"), F.collect_list("anchor").alias("shared"))
    texts = written(
        keyed.select("rid", "text").join(lists, "rid").dropDuplicates(["rid"]), "texts")
    passages = written(texts.mapInArrow(lambda b: _passages(b, window), PASSAGES), "passages")
    spans = repeated_spans(passages, window, split).groupBy(F.col("r1").alias("rid")).agg(F.collect_list(F.struct("first", "stop")).alias("spans"))
    changed = texts.select("rid", "text").join(spans, "rid").mapInArrow(
        _without, "rid bigint, n_removed bigint, kept string").withColumnRenamed("rid", "of")
    whole = F.col("copy") & (F.col("n_words") >= window)
    return rows.join(changed, F.col("rid") == F.col("of"), "left").select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, EMPTY_SHA).otherwise(F.coalesce(F.sha2("kept", 256), "sha")).alias("kept_sha256"),
        F.when(whole, "").otherwise(F.col("kept")).alias("kept"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, {LAST}) AS place,
                  regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
w AS (SELECT rid, place, unnest(range(1, len(words) - {WINDOW - 2})) AS pos, words FROM d WHERE len(words) >= {WINDOW}),
r AS (SELECT rid, place, pos, array_to_string(words[pos:pos + {WINDOW - 1}], ' ') AS run FROM w),
f AS (SELECT rid, pos, min(place) OVER (PARTITION BY run) < place AS again FROM r),
k AS (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
g AS (SELECT rid, word, pos, coalesce(bool_or(again) OVER (
        PARTITION BY rid ORDER BY pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), FALSE) AS gone
      FROM k LEFT JOIN f USING (rid, pos)),
s AS (SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
      FROM g GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (rid)
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).drop("kept")
