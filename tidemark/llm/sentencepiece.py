"""SentencePiece encoding and decoding with a unigram vocabulary.

Encoding finds the segmentation with the highest sum of piece scores (Viterbi). Pieces are found
with a double-array trie over UTF-8 bytes: from a state s the byte c leads to base[s] + c if
check there names s. A character that no piece covers costs ten less than the worst piece and
falls back to its bytes. Spaces become the marker U+2581, one is put in front; decoding undoes both.

No piece crosses from text into a marker, so a text is cut there and each part is segmented on its own: the best whole is
made of best parts. Parts repeat, so each worker remembers a bounded number of them. The vocabulary's scores
are taken as they are; ties go to the longer first piece, as the piece that starts earlier is seen first.

Defined results. NULL text has NULL ids and no tokens; empty text has none. Texts of any length are encoded whole. The
marker character itself decodes as a space. Rows repeating an id are encoded each. Other columns are never read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBERED = 400_000  # parts a worker remembers at most
BATCH_BYTES = 1 << 23
# Fixed values of the file format: kinds of pieces, and the marker.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
MARK = "▁"
UNKNOWN_COST = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised message; fixed-size and length-delimited values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = varint() if size is None else size
        yield key >> 3, data[at:at + size]
        at += size


class Vocabulary:
    """Pieces, scores and kinds of a model file, and the trie over the pieces that text may use."""

    def __init__(self, model: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.prefix, squeeze = True, True
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 3:
                spec = dict(_fields(value))
                self.prefix, squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2) or not spec.get(5, 1):
                    raise ValueError("the model rewrites characters; only plain text is supported")
        if squeeze:
            raise ValueError("the model squeezes spaces; only lossless models are supported")
        usable = {i for i, k in enumerate(self.kinds) if k in (NORMAL, USER_DEFINED)}
        self.base, self.check, self.value = double_array({self.pieces[i].encode(): i for i in usable})
        self.bytes = [self.pieces.index(f"<0x{b:02X}>") if f"<0x{b:02X}>" in self.pieces else -1 for b in range(256)]
        if -1 in self.bytes:
            raise ValueError("the model has no byte fallback")
        self.unknown = min(self.scores[i] for i in usable) - UNKNOWN_COST
        crossing = any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in usable)
        self.part = re.compile(".+" if crossing else f"{MARK}+[^{MARK}]*|[^{MARK}]+", re.DOTALL)
        self.by_word = not crossing and self.prefix
        self.plain = [self._plain(i) for i in range(len(self.pieces))]

    def _plain(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.kinds[i] == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if self.kinds[i] == CONTROL else self.pieces[i].replace(MARK, " ").encode()


def double_array(words: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """base, check and value of a trie: state 0 is the root, value is -1 where no word ends."""
    root: dict = {}
    for word, value in words.items():
        node = root
        for byte in word:
            node = node.setdefault(byte, {})
        node[-1] = value
    window = 1024
    room = 4 * sum(map(len, words)) + 4 * window  # bytes of all words bound the states; gaps come on top
    used = bytearray(room)
    taken = np.frombuffer(used, np.uint8)
    base, check, value = [0] * room, [-1] * room, [-1] * room
    used[0] = 1
    check[0] = 0
    free, dense, last = 1, 1, 0  # no gap lies before ``free``, few before ``dense``
    todo = [(0, root)]
    while todo:
        state, node = todo.pop()
        value[state] = node.get(-1, -1)
        children = sorted(b for b in node if b >= 0)
        if not children:
            continue
        free = used.index(0, free)
        if len(children) == 1:
            slot = used.index(0, max(free, children[0] + 1))
        else:
            slot, tried = max(dense, children[0] + 1), 0
            while True:  # where the first child goes, so that all its siblings fall into gaps
                fits = taken[slot:slot + window] == 0
                for byte in children[1:]:
                    gap = byte - children[0]
                    fits &= taken[slot + gap:slot + gap + window] == 0
                if fits.any():
                    slot += int(fits.argmax())
                    break
                slot, tried = slot + window, tried + 1
            if tried > 2:
                dense = max(dense, slot - window)
        at = slot - children[0]
        base[state] = at
        for byte in children:
            used[at + byte] = 1
            check[at + byte] = state
            todo.append((at + byte, node[byte]))
        last = max(last, at + children[-1])
    return base[:last + 1], check[:last + 1], value[:last + 1]


class Encoder(dict):
    """Ids of parts as packed 32-bit integers; a dictionary that segments what it has not seen."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        super().__init__()
        self.vocabulary, self.remembered = vocabulary, remembered

    def __missing__(self, word: str) -> bytes:
        """A word without spaces, as it stands behind a space."""
        ids = self.best(MARK + word)
        if len(word) <= 64:
            if len(self) >= self.remembered:
                self.clear()
            self[word] = ids
        return ids

    def best(self, part: str) -> bytes:
        v = self.vocabulary
        base, check, value, scores = v.base, v.check, v.value, v.scores
        data = part.encode("utf-8", "replace")
        size, states = len(data), len(check)
        lowest = float("-inf")
        best, back, piece = [lowest] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
        best[0] = 0.0
        start = 0
        while start < size:
            lead = data[start]
            step = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, state, covered = best[start], 0, False
            for at in range(start, size):
                following = base[state] + data[at]
                if following >= states or check[following] != state or not base[state]:
                    break
                state = following
                found = value[state]
                if found >= 0:
                    end = at + 1
                    covered = covered or end == start + step
                    total = here + scores[found]
                    if total > best[end]:
                        best[end], back[end], piece[end] = total, start, found
            if not covered:
                end = start + step
                total = here + v.unknown
                if total > best[end]:
                    best[end], back[end], piece[end] = total, start, -1
            start += step
        ids, end = [], size
        while end:
            start = back[end]
            if piece[end] >= 0:
                ids.append(piece[end])
            else:
                ids.extend(v.bytes[b] for b in reversed(data[start:end]))
            end = start
        return struct.pack(f"<{len(ids)}i", *reversed(ids))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.vocabulary.by_word and MARK not in text:
            words = text.split(" ")
            if "" not in words:
                return b"".join([self[w] for w in words])
        marked = (MARK if self.vocabulary.prefix else "") + text.replace(" ", MARK)
        return b"".join([self.best(part) for part in self.vocabulary.part.findall(marked)])


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    plain = vocabulary.plain
    data = b"".join([plain[i] for i in ids])
    if vocabulary.prefix and data[:1] == b" ":
        data = data[1:]
    return data.decode("utf-8", "replace")


def _batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows with about BATCH_BYTES of ``column`` in a batch, one row at least."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * BATCH_BYTES / max(1, batch.column(column).nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(vocabulary)
    for batch in _batches(batches, "text"):
        texts = batch.column("text").to_pylist()
        packed = [encoder.encode(t) if t else b"" for t in texts]
        offsets = np.zeros(len(texts) + 1, np.int32)
        np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
        ids = np.frombuffer(b"".join(packed), np.int32)
        exact = [decode(vocabulary, ids[a:b].tolist()) == t if t is not None else None
                 for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True)]
        missing = pa.array([t is None for t in texts])
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=missing)
        rest = [batch.column(n) for n in batch.schema.names if n != "text"]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*rest, lists, pa.array(np.diff(offsets).astype(np.int64)), pa.array(exact, pa.bool_())],
            [*names, "ids", "n_tokens", "round_trip"])


def load(path: str = MODEL) -> Vocabulary:
    with open(path, "rb") as file:
        return Vocabulary(file.read())


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, and whether decoding the ids gives the text again.

    The driver reads the model; what it broadcasts is one vocabulary, whatever the table's size.
    """
    held = docs.sparkSession.sparkContext.broadcast(load(path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _encoded(batches, held.value),
        f"doc_id {kind}, ids array<int>, n_tokens bigint, round_trip boolean")


def _decoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    for batch in _batches(batches, "ids"):
        texts = [None if ids is None else decode(vocabulary, ids) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode_ids(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of (doc_id, ids); ids outside the vocabulary are an error."""
    held = rows.sparkSession.sparkContext.broadcast(load(path))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(
        lambda batches: _decoded(batches, held.value), f"doc_id {kind}, text string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
