"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

Spaces become the mark U+2581 with one mark put in front, and the text is cut before every run of marks. No
piece of the vocabulary continues over such a cut, so the best path of a text is the chain of its words' best
paths. The distinct words of a batch are sorted, which makes them a trie read depth-first: each word keeps the
forward scores of the prefix that it shares with the word before it, and only its new characters are scored.

The best path has the largest sum of piece scores; of equal sums, the path whose last piece is longer wins at
each position. A character without a piece costs more than any piece and is written as its UTF-8 bytes' pieces.

Defined results: null text has null ids and n_pieces 0; empty text has no pieces. U+2581 in a text reads back
as a space. Repeated rows are encoded one by one; very long texts and words take memory in proportion.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import bounded_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Distinct words that a worker remembers before it starts anew.
MEMO = 600_000
_NORMAL, _USER, _BYTE = 1, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
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
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 4 if kind == 5 else 8
            at += size
            yield key >> 3, data[at - size : at]


class Vocabulary:
    """Pieces with scores, read from a SentencePiece model file (the driver reads it; executors get the bytes)."""

    def __init__(self, model: bytes) -> None:
        self.scores: dict[str, tuple[float, int]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for number, value in _fields(model):
            if number != 1:
                continue
            piece, score, kind = "", 0.0, _NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            at = len(self.bytes_of)
            raw = b""
            if kind in (_NORMAL, _USER):
                self.scores[piece] = (score, at)
                raw = piece.replace(MARK, " ").encode()
            elif kind == _BYTE:
                self.byte_ids[int(piece[3:5], 16)] = at
                raw = bytes([int(piece[3:5], 16)])
            self.bytes_of.append(raw)
        if any(MARK in p.lstrip(MARK) for p in self.scores):
            raise ValueError("a piece goes on over a word's mark")
        self.unknown = min((s for s, _ in self.scores.values()), default=0.0) - 10
        #: Pieces by their characters from the last to the first: node = {char: node, "": (score, id)}.
        self.backward: dict = {}
        for piece, found in self.scores.items():
            node = self.backward
            for char in reversed(piece):
                node = node.setdefault(char, {})
            node[""] = found
        #: Characters that only ever stand alone; a text may be cut around them.
        joined = {c for p in self.scores if len(p) > 1 for c in p}
        self.cuts_newline = "\n" not in joined


def split_words(text: str, newline: bool) -> list[str]:
    """The marked words of a text, in order; joined they give the marked text."""
    marked = MARK + text.replace(" ", MARK)
    if MARK + MARK in marked:
        words = re.findall(f"{MARK}+[^{MARK}]*", marked)
    else:
        words = [MARK + w for w in marked[1:].split(MARK)]
    if newline and "\n" in marked:
        words = [x for w in words for x in (re.split("(\n)", w) if "\n" in w else (w,)) if x]
    return words


def encode_sorted(words: list[str], vocabulary: Vocabulary) -> Iterator[tuple[str, list[int]]]:
    """Each word of a sorted list with the ids of its best path."""
    root, unknown = vocabulary.backward, vocabulary.unknown
    byte_ids = vocabulary.byte_ids
    best, came, piece = [0.0], [0], [-1]
    before = ""
    for word in words:
        keep = len(commonprefix((before, word)))
        del best[keep + 1 :], came[keep + 1 :], piece[keep + 1 :]
        for end in range(keep + 1, len(word) + 1):
            top, top_at, top_piece = float("-inf"), end - 1, -1
            node, at = root, end - 1
            while at >= 0 and (node := node.get(word[at])) is not None:
                if (found := node.get("")) is not None and (score := best[at] + found[0]) >= top:
                    top, top_at, top_piece = score, at, found[1]
                at -= 1
            if word[end - 1] not in vocabulary.scores and (score := best[end - 1] + unknown) > top:
                top, top_at, top_piece = score, end - 1, -1
            best.append(top)
            came.append(top_at)
            piece.append(top_piece)
        ids: list[int] = []
        at = len(word)
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids.extend(byte_ids[b] for b in reversed(word[at - 1].encode()))
            at = came[at]
        ids.reverse()
        before = word
        yield word, ids


class Encoder:
    """Keeps the paths of the words it has met in one array."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.paths: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.flat, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids: list[int] = []
        counts: list[int] = []
        for word, path in encode_sorted(sorted(words), self.vocabulary):
            self.known[word] = len(self.known)
            ids.extend(path)
            counts.append(len(path))
        count = np.array(counts, np.int64)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, np.array(ids, np.int32)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text ends)."""
        if len(self.known) > MEMO:
            self._forget()
        words: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                words += split_words(text, self.vocabulary.cuts_newline)
            ends.append(len(words))
        if new := set(words).difference(self.known):
            self._learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        count = self.count[at]
        stop = np.concatenate([[0], np.cumsum(count)])
        where = np.arange(stop[-1]) + np.repeat(self.first[at] - stop[:-1], count)
        return self.flat[where], stop[np.array(ends)]


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of ids: the inverse of encoding, but for U+2581, which reads as a space."""
    raw = b"".join(map(vocabulary.bytes_of.__getitem__, ids))
    return raw.removeprefix(b" ").decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model: str | bytes = MODEL, verify: bool = True) -> DataFrame:
    """doc_id, n_pieces, piece_ids, round_trip (the decoded ids give the text back; null for null text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    data = open(model, "rb").read() if isinstance(model, str) else model
    shared = spark.sparkContext.broadcast(data)  # one vocabulary file; its size does not follow the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        encoder = Encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            start, size = 0, 0
            for i, text in enumerate(texts):
                size += len(text or "")
                if size > 4 << 20 or i + 1 == len(texts):
                    part = texts[start : i + 1]
                    ids, ends = encoder.encode(part)
                    same = [None] * len(part)
                    if verify:
                        flat = ids.tolist()
                        same = [None if t is None else decode(flat[a:b], vocabulary) == t.replace(MARK, " ") for t, a, b in zip(part, ends[:-1], ends[1:], strict=True)]
                    null = pa.array([t is None for t in part])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=null) if len(part) else pa.array([], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(np.diff(ends), pa.int64()), lists, pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "piece_ids", "round_trip"])
                    start, size = i + 1, 0

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("n_pieces", "long").add("piece_ids", T.ArrayType(T.IntegerType())).add("round_trip", "boolean"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: every document's piece ids."""
    return encode_documents(docs)
