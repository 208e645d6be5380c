"""Language identification by word-first backoff.

A word that some language's list knows is scored by its log frequency in each language. An unseen word falls
back to the longest character n-grams (5 down to 1) of which any is known, scored by their mean log frequency.
A text's language is the one with the largest sum; its score is the softmax of the sums.

Training learns from a bounded sample of labelled texts: about `docs_per_lang` of each language, less where there are
so many languages that this would exceed `sample` texts, and one at least. A text is in the sample if its hash lies
below its language's share, so nothing is ranked, and the choice does not depend on order, partitioning or ids; equal
texts of a language are learnt once. The sample's words are counted in full. Every language met in it can be
predicted. The model keeps the most frequent `words` words and `grams` n-grams of each length and language, less where
the languages are many, so that it has about `entries` numbers; a language that does not know a word adds only what
all unknown words of it cost, so rows hold known languages alone.

Defined results: null text, or text without a letter, is `und` with score 0. Without any labelled text every
document is `und`; an empty table gives no rows. Equal sums go to the alphabetically first language, equally frequent
words to the first in order. Repeated rows are predicted one by one. Very long texts and words are read whole, words
of over LONG_WORD letters piece by piece and without being remembered. Only doc_id, text and (for training) lang are
read, so extra columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, id_crc, stored, table

#: Bounds of the training sample (texts of a language, texts in all) and of the model.
DOCS_PER_LANG, SAMPLE = 4000, 64_000
WORDS, GRAMS, LONGEST, ENTRIES = 60_000, 20_000, 5, 2_000_000
#: A text's hash is taken modulo this for the sample.
SLOTS = 1 << 40
_LETTERS = re.compile(r"[^\W\d_]+")
#: Unseen words that a worker remembers before it starts anew, and the longest one.
MEMO, LONG_WORD = 400_000, 64
#: Distinct words and n-grams that a task counts before it hands them on; letters of a long word that are cut at once.
FLUSH, STRETCH = 500_000, 1 << 16


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def grams_of(word: str, n: int) -> Iterator[str]:
    """The n-grams of a word between marks (n = 1: its letters)."""
    padded = f"<{word}>" if n > 1 else word
    for i in range(len(padded) - n + 1):
        yield padded[i : i + n]


class LanguageModel:
    """Log frequencies by word and n-gram, for the languages that know them.

    Kind 0 are words, kind n the n-grams of n letters. A row's value in a language is that language's `base` of the
    row's kind, plus what the row's entry for the language says; `at` tells where a row's entries begin."""

    def __init__(self, langs: list[str], kind: np.ndarray, key: np.ndarray, lang: np.ndarray, count: np.ndarray) -> None:
        """One item of the arrays for each (kind, key, lang)."""
        self.langs = langs
        self.base = np.zeros((LONGEST + 2, len(langs)))  # the last kind: nothing known
        self.tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        order = np.lexsort((lang, key, kind)) if len(kind) else np.zeros(0, np.int64)
        kind, key, lang, count = kind[order], key[order], lang[order], count[order]
        new = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])]) if len(kind) else np.zeros(0, np.int64)
        self.at = np.r_[new, len(kind)]
        self.kind = kind[new]
        self.lang, self.more = lang.astype(np.int64), np.log((count + 0.5) / 0.5)
        for k in range(LONGEST + 1):
            rows = np.flatnonzero(self.kind == k)
            self.tables[k] = dict(zip(key[new[rows]].tolist(), rows.tolist(), strict=True))
            total = np.bincount(lang[kind == k], weights=count[kind == k], minlength=len(langs)) if len(kind) else np.zeros(len(langs))
            self.base[k] = np.log(0.5 / (np.maximum(total, 1) + 0.5 * max(1, len(rows))))

    def unseen(self, word: str) -> tuple[int, np.ndarray, np.ndarray]:
        """(kind, languages, values) of a word that no language knows."""
        for n in range(LONGEST, 0, -1):
            known, total, hits = self.tables[n], np.zeros(len(self.langs)), 0
            for start in range(0, len(word) + 2, STRETCH):
                rows: list[int] = []
                padded = f"<{word}>" if n > 1 else word
                for i in range(start, min(start + STRETCH, len(padded) - n + 1)):
                    if (row := known.get(padded[i : i + n])) is not None:
                        rows.append(row)
                if rows:
                    first, size = self.at[rows], self.at[np.array(rows) + 1] - self.at[rows]
                    entry = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                    total += np.bincount(self.lang[entry], weights=self.more[entry], minlength=len(self.langs))
                    hits += len(rows)
            if hits:
                langs = np.flatnonzero(total)
                return n, langs, total[langs] / hits
        return LONGEST + 1, np.zeros(0, np.int64), np.zeros(0)


def training_sample(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, sample: int = SAMPLE) -> DataFrame:
    """lang, text: the texts to learn from."""
    labelled = docs.where("text is not null and lang is not null").select("lang", "text")
    sizes = stored(docs.sparkSession, labelled.groupBy("lang").count(), "languages")
    each = max(1, min(docs_per_lang, sample // max(1, sizes.count())))
    share = sizes.select("lang", F.ceil(F.lit(each) / F.col("count") * SLOTS).alias("share"))
    chosen = labelled.join(share, "lang").where(F.pmod(F.xxhash64("text"), F.lit(SLOTS)) < F.col("share")).select("lang", "text")
    # A language whose only texts are copies may have none below its share: then it teaches its first one.
    met = stored(docs.sparkSession, chosen.withColumn("h", F.xxhash64("text")).dropDuplicates(["lang", "h"]).select("lang", "text"), "sample")
    silent = stored(docs.sparkSession, sizes.join(met.select("lang").distinct(), "lang", "left_anti").select("lang"), "silent")
    if silent.isEmpty():
        return met
    return met.union(labelled.join(silent, "lang", "left_semi").groupBy("lang").agg(F.min("text").alias("text")))


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, words: int = WORDS, grams: int = GRAMS, sample: int = SAMPLE, entries: int = ENTRIES) -> LanguageModel:
    """docs: text, lang. Rows without text or lang are not learnt from."""
    bounded_batches(docs.sparkSession)

    def rows(found: dict) -> pa.RecordBatch:
        keys = list(found)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "n", "key", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, c in Counter(words_of(text)).items():
                    found[lang, 0, word] += c
                    for n in range(1, LONGEST + 1):
                        for gram in grams_of(word, n):
                            found[lang, n, gram] += c
                        if len(found) > FLUSH:
                            yield rows(found)
                            found = Counter()
        yield rows(found)

    counts = training_sample(docs, docs_per_lang, sample).mapInArrow(count, "lang string, n int, key string, c long")
    counts = stored(docs.sparkSession, counts.groupBy("lang", "n", "key").agg(F.sum("c").alias("c")), "counts")
    langs = sorted(counts.select("lang").distinct().toArrow().column(0).to_pylist())
    half = max(1, entries // (2 * max(1, len(langs))))
    most = F.when(F.col("n") == 0, min(words, half)).otherwise(min(grams, max(1, half // LONGEST)))
    rank = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("c"), "key"))  # of the sample's words
    kept = counts.withColumn("rk", rank).where(F.col("rk") <= most).select("n", "key", "lang", "c").toPandas()  # about `entries` rows
    lang = pd.Index(langs).get_indexer(kept["lang"]) if langs else np.zeros(0, np.int64)
    return LanguageModel(langs, kept["n"].to_numpy(np.int64), kept["key"].to_numpy(object), lang, kept["c"].to_numpy(np.float64))


class Memo(dict):
    """Word to row; an unseen word gets a row of its own by backoff."""

    def __init__(self, model: LanguageModel) -> None:
        super().__init__(model.tables[0])
        self.model, self.rows = model, len(model.kind)
        self.at, self.kind, self.lang, self.more = model.at, model.kind, model.lang, model.more
        self.new: list[tuple[int, np.ndarray, np.ndarray]] = []

    def __missing__(self, word: str) -> int:
        at = self.rows + len(self.new)
        if len(word) <= LONG_WORD:
            self[word] = at
        self.new.append(self.model.unseen(word))
        return at

    def settle(self) -> None:
        """Put the new rows behind the others."""
        if self.new:
            ends = self.at[-1] + np.cumsum([len(x[1]) for x in self.new])
            self.at = np.concatenate([self.at, ends])
            self.kind = np.concatenate([self.kind, [x[0] for x in self.new]])
            self.lang = np.concatenate([self.lang, *(x[1] for x in self.new)])
            self.more = np.concatenate([self.more, *(x[2] for x in self.new)])
            self.rows += len(self.new)
            self.new = []


def predict(texts: list[str | None], memo: Memo) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    model = memo.model
    found: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    n, kinds = len(model.langs), LONGEST + 2
    if not n:
        return found
    ids: list[int] = []
    sizes, rows = [], []
    for i, text in enumerate(texts):
        words = words_of(text) if text else []
        if words and (words[0][0].isalpha() or any(c.isalpha() for w in words for c in w)):
            sizes.append(len(words))
            rows.append(i)
            ids.extend(map(memo.__getitem__, words))
    if not rows:
        return found
    memo.settle()
    id_, text = np.array(ids), np.repeat(np.arange(len(rows)), sizes)
    sums = np.bincount(text * kinds + memo.kind[id_], minlength=len(rows) * kinds).reshape(-1, kinds) @ model.base
    first = memo.at[id_]
    size = memo.at[id_ + 1] - first
    entry = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    sums += np.bincount(np.repeat(text * n, size) + memo.lang[entry], weights=memo.more[entry], minlength=len(rows) * n).reshape(-1, n)
    best = sums.argmax(axis=1)
    share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    for i, b, s in zip(rows, best.tolist(), share.tolist(), strict=True):
        found[i] = (model.langs[b], s)
    return found


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Every row of docs as a struct `doc`, with lang_pred and score. The model's size is bounded by train()."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(shared.value)
        for batch in batches:
            if memo.rows - len(shared.value.kind) > MEMO:
                memo = Memo(shared.value)
            texts = batch.column(1).to_pylist()
            found: list[tuple[str, float]] = []
            size, start = 0, 0
            for i, text in enumerate(texts):  # so many bytes of texts at once
                size += len(text or "")
                if size > 4 << 20 or i + 1 == len(texts):
                    found += predict(texts[start : i + 1], memo)
                    size, start = 0, i + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc", "lang_pred", "score"])

    rows = docs.select(F.struct("*").alias("doc"), "text")
    schema = rows.select("doc").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc() % 4 == 2
    model = train(docs.where(~held_out))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc.doc_id", "lang_pred", "score").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in no language that the labels teach, or with no clear one, go."""
    found = identify(docs, train(docs.where(id_crc() % 4 != 2)))
    return found.where("lang_pred <> 'und' and score >= 0.5").select("doc.*")
