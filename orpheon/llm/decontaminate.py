"""Benchmark decontamination by the q-gram lemma.

An item of n bytes that occurs in a text with at most e edits shares at least n - q + 1 - q * e of its q-grams
with that place, and their diagonals (place in the text minus place in the item) lie within e of each other. So
the q-grams of an item that are met are counted, each once, in overlapping diagonal bands for each item and text; bands
that meet the bound, and their neighbours that do, are a region, and a banded alignment of the item against the region
verifies it and gives the places and the edits.

Texts and items are compared as bytes with A-Z lowered and every white-space byte read as a space; places are
byte offsets in the original text. The budget is e = int(edit_rate * n), or less where the bound would fall
below 1. Items shorter than q bytes are searched exactly.

Items go to the executors in blocks of at most BLOCK_BYTES, of which the driver holds one; each block is one pass over
the texts, and after PASSES passes their result is written before the next ones begin.

Defined results: null or empty texts and items match nothing; an empty benchmark matches nothing, and an empty table
gives no rows; equal items all match; repeated rows are searched one by one; very long texts are searched whole,
STRETCH bytes at a time. Of one item's overlapping matches in a text the one with the fewest edits counts, then the
first. Columns of docs pass through untouched inside the struct `doc`, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, mix, stored, table, text_buffers

Q, EDIT_RATE = 10, 0.08
#: Bytes of items that a pass has at most, and passes that are chained before their result is written.
BLOCK_BYTES, PASSES = 8 << 20, 8
#: Bytes of texts whose grams are looked up at once, and (gram, item place) pairs that are held at once.
STRETCH, POSTINGS = 4 << 20, 4 << 20
_FOLD = np.array([c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256)], np.uint8)
_FILTER_BITS = 22
MATCHES = T.ArrayType(T.StructType().add("item_id", T.LongType()).add("start", T.LongType()).add("end", T.LongType()).add("edits", T.IntegerType()))
_ARROW_MATCH = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])


def gram_codes(data: np.ndarray) -> np.ndarray:
    """A 64-bit code of the Q = 10 bytes from each position."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    one = data.astype(np.uint64)
    two = one[:-1] | one[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    n = len(data) - Q + 1
    return mix(eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ mix(two[8 : 8 + n]))


def align(item: np.ndarray, text: np.ndarray, budget: int) -> np.ndarray:
    """For each place in text (and its end) the edits of the best piece that ends there, or budget + 1 where they are more.

    Only diagonals on which a whole item fits with at most `budget` edits are walked, and the walk ends once nothing is
    left within the budget."""
    n, m = len(item), len(text)
    out = np.full(m + 1, budget + 1, np.int32)
    width = m - n + 2 * budget + 1  # diagonals -budget to m - n + budget: place in the text minus place in the item
    if width < 1:
        return out
    shift = np.arange(-budget, width - budget)
    steps = np.arange(width, dtype=np.int32)
    row = np.where(shift >= 0, 0, n + 1).astype(np.int32)  # edits of no item byte against nothing; a piece may begin anywhere
    padded = np.full(n + width, 256, np.int16)  # byte i + d of the text stands at budget + i + d
    padded[budget : budget + m] = text[: max(0, min(m, n + width - budget))]
    symbols = item.astype(np.int16)
    for i in range(n):
        step = row + (padded[i : i + width] != symbols[i])
        np.minimum(step[:-1], row[1:] + 1, out=step[:-1])
        step -= steps
        np.minimum.accumulate(step, out=step)
        step += steps
        # Before the text's first byte the item can only be left out.
        row = step
        if i < budget:
            row[: budget - i - 1] = n + 1
            row[budget - i - 1 : budget - i] = i + 1
        if not i & 7 and int(row.min()) > budget:
            return out
    ends = n + shift
    fits = (ends >= 0) & (ends <= m)
    out[ends[fits]] = np.minimum(row[fits], budget + 1)
    return out


def locate(item: np.ndarray, text: np.ndarray, budget: int) -> list[tuple[int, int, int]]:
    """(edits, start, end) of the occurrences of item within budget edits; of those that overlap the one with the fewest
    edits, then the one that ends first."""
    n = len(item)
    found: list[tuple[int, int, int]] = []
    raw, sought = text.tobytes(), item.tobytes()
    at = raw.find(sought)
    while at >= 0:
        found.append((0, at, at + n))
        at = raw.find(sought, at + n)
    edges = [0, *(x for _, a, b in found for x in (a, b)), len(text)]
    if not any(b - a >= n - budget for a, b in zip(edges[::2], edges[1::2], strict=True)):
        return found
    cost = align(item, text, budget)
    for _, a, b in found:
        cost[a + 1 : b + n - budget] = budget + 1
    while (edits := int(cost.min())) <= budget:
        end = int(cost.argmin())
        back = align(item[::-1], text[max(0, end - n - budget) : end][::-1], edits)
        start = end - int(np.flatnonzero(back <= edits)[0])
        cost[end] = budget + 1
        if all(end <= a or start >= b for _, a, b in found):
            found.append((edits, start, end))
            cost[start + 1 : end + n - budget] = budget + 1
    return found


class Index:
    """The q-grams of a block of items, with a bit filter in front."""

    def __init__(self, items: list[tuple[int, str]], edit_rate: float = EDIT_RATE) -> None:
        self.ids, self.items, self.budget, self.need, self.short = [], [], [], [], []
        codes, where, offsets = [], [], []
        for item_id, text in items:
            data = _FOLD[np.frombuffer(text.encode(), np.uint8)]
            n = len(data)
            if n < Q:
                if n:
                    self.short.append((item_id, data.tobytes()))
                continue
            e = max(0, min(int(edit_rate * n), (n - Q) // Q))
            found = gram_codes(data)
            codes.append(found)
            where.append(np.full(len(found), len(self.ids)))
            offsets.append(np.arange(len(found)))
            self.ids.append(item_id)
            self.items.append(data)
            self.budget.append(e)
            self.need.append(n - Q + 1 - Q * e)
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.item_of = (np.concatenate(where) if codes else np.zeros(0, np.int64))[order]
        self.offset_of = (np.concatenate(offsets) if codes else np.zeros(0, np.int64))[order]
        self.codes, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.codes >> np.uint64(64 - _FILTER_BITS)] = True
        self.lengths = np.array([len(x) for x in self.items], np.int64)
        self.budgets, self.needs = np.array(self.budget, np.int64), np.array(self.need, np.int64)
        self.bands = np.maximum(32, self.budgets)  # diagonals between the beginnings of two bands
        self.least = min(self.need, default=0)

    def _hits(self, at: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, band) of all pairs of a text's gram and an equal one of an item, once for each of the item's grams, in order."""
        known = None
        grams = int(self.lengths.max())
        lowest = (int(at.min()) - grams) // 32 - 1
        bands = int(at.max()) // 32 + 2 - lowest
        if len(self.items) * bands * grams >= 1 << 63:
            raise ValueError("a block of items is too large for texts of this length")
        count = self.count[slot]
        ends = np.cumsum(count)
        first = 0
        while first < len(at):  # so many pairs at once; what was met before counts no more
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + POSTINGS, side="right")))
            n = count[first:last]
            posting = np.repeat(self.first[slot[first:last]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            item, gram = self.item_of[posting], self.offset_of[posting]
            diagonal = np.repeat(at[first:last], n) - gram
            width = self.bands[item]
            band = diagonal // width
            also = diagonal - band * width < self.budgets[item]  # the band before reaches so far
            item, gram, band = (np.concatenate([x, x[also] - k]) for x, k in ((item, 0), (gram, 0), (band, 1)))
            key = np.unique((item * bands + band - lowest) * grams + gram)
            known = key if known is None else np.union1d(known, key)
            first = last
        if known is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return known // grams // bands, known // grams % bands + lowest

    def regions(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, low, high): the stretches of texts in which an item may stand. data: folded texts; ends: their offsets."""
        if not len(self.codes):
            return
        reach = int(self.lengths.max() + 3 * self.bands.max()) + Q
        size = max(STRETCH, 4 * reach)
        for begin in range(0, max(1, len(data)), size):  # stretches overlap, so each band is whole in one of them
            low = max(0, begin - reach)
            codes = gram_codes(data[low : begin + size])
            at = np.flatnonzero(self.filter[codes >> np.uint64(64 - _FILTER_BITS)])
            if not len(at):
                continue
            slot = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
            real = self.codes[slot] == codes[at]
            at, slot = at[real] + low, slot[real]
            text = np.searchsorted(ends, at, side="right") - 1
            inside = at + Q <= ends[text + 1]
            at, slot, text = at[inside], slot[inside], text[inside]
            for rows in np.split(np.arange(len(at)), np.flatnonzero(np.diff(text)) + 1):
                if len(rows):
                    yield from self._regions_of(int(text[rows[0]]), at[rows], slot[rows], ends)

    def _regions_of(self, text: int, at: np.ndarray, slot: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        if len(at) < self.least and int(self.count[slot].sum()) < self.least:
            return
        item, band = self._hits(at, slot)
        new = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
        enough = np.diff(np.r_[new, len(item)]) >= self.needs[item[new]]
        item, band = item[new[enough]], band[new[enough]]
        if not len(item):
            return
        # Neighbouring bands are one region, and so are bands whose stretches overlap.
        begin = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (band[1:] > band[:-1] + 1)])
        for a, b in zip(begin.tolist(), np.r_[begin[1:], len(item)].tolist(), strict=True):
            k = int(item[a])
            e, n, width = self.budget[k], len(self.items[k]), int(self.bands[k])
            low = max(int(ends[text]), int(band[a]) * width - e)
            yield text, k, low, min(int(ends[text + 1]), (int(band[b - 1]) + 1) * width + 2 * e + n)

    def search(self, data: np.ndarray, ends: np.ndarray) -> list[list[dict]]:
        """The matches of each text."""
        data = _FOLD[data]
        found: list[dict[int, list]] = [{} for _ in range(len(ends) - 1)]
        for text, item, low, high in self.regions(data, ends):
            at = low - int(ends[text])
            for edits, start, end in locate(self.items[item], data[low:high], self.budget[item]):
                found[text].setdefault(item, []).append((edits, at + start, at + end))
        rows: list[list[dict]] = []
        for text, by_item in enumerate(found):
            row = []
            for item, hits in by_item.items():
                taken: list[tuple[int, int, int]] = []
                for hit in sorted(set(hits)):
                    if all(hit[2] <= t[1] or hit[1] >= t[2] for t in taken):
                        taken.append(hit)
                row += [{"item_id": self.ids[item], "start": s, "end": t, "edits": e} for e, s, t in taken]
            if self.short:
                whole = data[ends[text] : ends[text + 1]].tobytes()
                for item_id, item in self.short:
                    at = whole.find(item)
                    while at >= 0:
                        row.append({"item_id": item_id, "start": at, "end": at + len(item), "edits": 0})
                        at = whole.find(item, at + len(item))
            rows.append(sorted(row, key=lambda m: (m["start"], m["item_id"], m["end"])))
        return rows


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items, at most so many bytes (or one item) at a time; the driver holds one block."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.where("text is not null and text <> ''").select(F.col("item_id").cast("long"), "text").toLocalIterator():
        if block and size + len(row.text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text)
    yield block


def find_benchmark(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES, passes: int = PASSES) -> DataFrame:
    """Every row of docs as a struct `doc`, with its `matches` (item_id, start, end, edits)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.struct("*").alias("doc"), "text", F.array().cast(MATCHES).alias("matches"))
    schema = rows.schema
    chained = 0
    for block in _blocks(benchmark, block_bytes):
        if chained == passes:  # so that no more broadcasts are alive and no more indexes held by a task
            rows, chained = stored(spark, rows, "searched"), 0
        chained += 1
        shared = spark.sparkContext.broadcast((block, edit_rate))  # at most BLOCK_BYTES of text, or one item

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value)
            for batch in batches:
                data, ends = text_buffers(batch.column(1))
                part: list[list[dict]] = []
                first = 0
                for i in range(len(batch)):  # so many bytes of texts at once
                    if ends[i + 1] - ends[first] > STRETCH or i + 1 == len(batch):
                        part += index.search(data[ends[first] : ends[i + 1]], ends[first : i + 2] - ends[first])
                        first = i + 1
                matches = [a + b for a, b in zip(batch.column(2).to_pylist(), part, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(matches, pa.list_(_ARROW_MATCH))], ["doc", "text", "matches"])

        rows = rows.mapInArrow(run, schema)
    return rows.select("doc", "matches")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc.doc_id", (F.size("matches") > 0).alias("contaminated"), F.array_sort(F.array_distinct("matches.item_id")).alias("item_ids"), "matches")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    return find_benchmark(docs, table(spark, sf_dir, "benchmark")).where(F.size("matches") == 0).select("doc.*")
