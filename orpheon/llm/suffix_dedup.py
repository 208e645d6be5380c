"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts somewhere else go.

A window is the `length` bytes from one place. Its anchor is the first of the 32-byte grams in it with the
smallest hash, a function of its bytes alone, so equal windows have equal anchors, equally far from their start.
Consecutive windows with their anchor at one place form a context, the bytes that they span; a text is about one context for every 85 bytes. Anchors that occur once are
dropped, equal contexts of an anchor become one with a count, and the remaining bytes of an anchor meet in one
task. There a block of contexts is suffix-sorted, and threshold-bounded interval expansion on its Burrows-Wheeler
transform finds the longest common prefixes by increasing value: an interval of a string w yields those of all
cw, an interval end that has no value yet gets the length of w, and the expansion stops at `length`. Places
without a value share `length` bytes or more with their neighbour; such a run is a repeat if its contexts' counts
add up to two.

An anchor with more than CROWD bytes of different contexts is not gathered. Its contexts are cut anew, before their
bytes are dealt out, by a second anchor under another hash, then by a third; what is still too much is cut into single
windows, which are dealt out by their own hash. Equal windows stay together at each level, and all go through the
transform.

Defined results: null and empty texts have no bytes and nothing to remove; texts shorter than `length` keep all; very
long texts are scanned in the worker that reads them, at a few dozen times their size in memory. An empty table gives
no rows. Matches never cross documents. Equal rows are different occurrences and so repeat each other; of equal gram
hashes in a window the first place is the anchor. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import prefilter
from .common import bounded_batches, mix, stored, table, text_buffers

LENGTH, GRAM = 200, 32
#: Bytes that are suffix-sorted at once (they fit a core's cache), and bytes of one anchor's contexts that one task takes.
BLOCK, CROWD = 256 << 10, 512 << 10
#: So many hashes choose anchors, one after the other, before a crowd is cut into single windows.
LEVELS = 3
_SPANS = T.ArrayType(T.StructType().add("a", T.IntegerType()).add("b", T.IntegerType()))
_ARROW_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def gram_hashes(data: np.ndarray, level: int = 0) -> np.ndarray:
    """A hash of the GRAM = 32 bytes from each place; each level has its own."""
    h = data.astype(np.uint64) + np.uint64(1)
    factor, size = np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while size < GRAM:
            h = h[:-size] * factor + h[size:]
            factor = factor * factor
            size *= 2
    return mix(h ^ np.uint64(level * 0x5851F42D4C957F2D & (1 << 64) - 1))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, low = 1, x
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[: len(x) - width + 1], low[width - size :])


def contexts(data: np.ndarray, ends: np.ndarray, length: int, level: int = 0) -> tuple[np.ndarray, ...]:
    """(text, anchor, first, last): the runs of windows with one anchor place; places are within the text.

    The anchor has the smallest upper half of the hash, and of equal ones it is the first, whatever else is scanned
    with it. No two windows of a context are equal: their distances to the anchor differ."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(data) < length:
        return none
    hashes = gram_hashes(data, level)
    below = np.uint64((1 << 32) - 1)  # places stand in the lower half
    at = (sliding_min(hashes & ~below | np.arange(len(hashes), dtype=np.uint64), length - GRAM + 1) & below).astype(np.int64)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(at)]
    place = np.flatnonzero(np.arange(len(at)) + length <= ends[text + 1])
    if not len(place):
        return none
    at, text = at[place], text[place]
    begin = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    end = np.r_[begin[1:], len(at)] - 1
    text = text[begin]
    return text, hashes[at[begin]].view(np.int64), place[begin] - ends[text], place[end] - ends[text]


def scan_contexts(docs: DataFrame, length: int) -> DataFrame:
    """anchor, form (hash of the context's bytes), doc_id, hash (of the text), first, last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_buffers(batch.column(2))
            start = 0
            for i in range(len(batch)):
                if ends[i + 1] - ends[start] > 1 << 20 or i + 1 == len(batch):
                    part, at = data[ends[start] : ends[i + 1]], ends[start : i + 2] - ends[start]
                    text, anchor, first, last = contexts(part, at, length)
                    raw = memoryview(part)
                    begin, end = at[text] + first, at[text] + last + length
                    form = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), np.uint64, len(text))
                    rows = pa.array(text + start)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(form.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["anchor", "form", "doc_id", "hash", "first", "last"])
                    start = i + 1

    return docs.mapInArrow(run, "anchor long, form long, doc_id long, hash int, first int, last int")


def suffix_order(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, eight): the places of a cyclic text in the order of their first 256 bytes or more, and the first eight bytes of each."""
    n = len(text)
    wrapped = np.concatenate([text, text[: min(n, 8)]])
    while len(wrapped) < n + 8:
        wrapped = np.concatenate([wrapped, text])
    eight = np.zeros(n, np.uint64)
    for k in range(8):
        eight = eight << np.uint64(8) | wrapped[k : k + n].astype(np.uint64)
    order = np.argsort(eight)
    key, size = eight[order], 8
    while True:
        new = np.r_[False, key[1:] != key[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if size >= length or new[1:].all():
            return order, eight
        both = rank * n + rank[(np.arange(n) + size) % n]
        order = np.argsort(both)
        key = both[order]
        size *= 2


def long_runs(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, run): places in suffix order, and for each the number of its run, whose members share `length` bytes."""
    order, eight = suffix_order(text, length)
    n = len(text)
    before = text[order - 1]  # the transform: the byte before each suffix, cyclically
    steps = np.empty(n, np.int64)  # where the suffix with that byte in front stands
    steps[np.argsort(before, kind="stable")] = np.arange(n)
    prefix = np.full(n + 1, -1)  # longest common prefix with the suffix before; -1: not known yet
    prefix[0] = prefix[n] = 0
    sorted_eight = eight[order]
    differ = sorted_eight[1:] ^ sorted_eight[:-1]
    known = np.flatnonzero(differ)
    top = np.floor(np.log2(differ[known].astype(np.float64))).astype(np.int64)
    top += (differ[known] >> np.minimum(top, 63).astype(np.uint64) == 0) * -1  # rounding up to the next power
    prefix[known + 1] = 7 - (top >> 3)
    ends = np.r_[known, n - 1]
    starts = np.r_[0, known + 1]
    pick = prefix[ends + 1] == 7
    pick[-1] = True
    low, high = starts[pick], ends[pick]  # intervals of eight bytes whose end got the value 7
    for value in range(8, length):
        if not len(low):
            break
        size = high - low + 1
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        group = np.repeat(np.arange(len(low)), size) << 8 | before[at]
        by = np.argsort(group, kind="stable")
        group, to = group[by], steps[at[by]]
        last = np.r_[group[1:] != group[:-1], True]
        first = np.r_[True, last[:-1]]
        low, high = to[first], to[last]
        fresh = prefix[high + 1] < 0
        low, high = low[fresh], high[fresh]
        prefix[high + 1] = value
    return order, np.cumsum(prefix[:n] >= 0)


def repeated(pieces: list[bytes], weights: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each context, the runs of window places (first, last) that repeat; weights: how often each context occurs."""
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    sizes = np.array([len(p) for p in pieces])
    at = np.cumsum(sizes + 1) - sizes - 1
    weight = np.zeros(len(text), np.int64)
    windows = sizes - length + 1
    place = np.repeat(at - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    weight[place] = np.repeat(weights, windows)
    order, run = long_runs(text, length)
    total = np.bincount(run, weights=weight[order])
    twice = np.zeros(len(text), bool)
    twice[order] = total[run] >= 2
    hit = twice[place]
    piece = np.repeat(np.arange(len(pieces)), windows)
    begin = np.flatnonzero(hit & np.r_[True, ~hit[:-1] | (piece[1:] != piece[:-1])])
    end = np.flatnonzero(hit & np.r_[~hit[1:] | (piece[1:] != piece[:-1]), True])
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    for p, a, b in zip(piece[begin].tolist(), (place[begin] - at[piece[begin]]).tolist(), (place[end] - at[piece[end]]).tolist(), strict=True):
        out[p].append((a, b))
    return out


def _spans(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in row] for row in found], _ARROW_SPANS)


def expand_contexts(forms: DataFrame, length: int, block: int) -> DataFrame:
    """anchor, form, spans of the contexts (anchor, form, n, bytes), of which an anchor has a bounded number of bytes."""

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        spans = repeated([r[3] for r in rows], [r[2] for r in rows], length)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), _spans(spans)], ["anchor", "form", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        group: dict[int, tuple] = {}
        ready_size = 0
        anchor = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != anchor:
                    size = sum(len(r[3]) + 1 for r in group.values())
                    if ready and ready_size + size > block:
                        yield solved(ready)
                        ready, ready_size = [], 0
                    ready += group.values()
                    ready_size += size
                    anchor, group = row[0], {}
                group.setdefault(row[1], row)
        if ready and ready_size + sum(len(r[3]) + 1 for r in group.values()) > block:
            yield solved(ready)
            ready = []
        if ready or group:
            yield solved([*ready, *group.values()])

    parts = max(8, int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return forms.select("anchor", "form", "n", "bytes").repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(run, T.StructType().add("anchor", "long").add("form", "long").add("spans", _SPANS))


def cut_anew(forms: DataFrame, length: int, level: int) -> DataFrame:
    """The contexts (anchor, form, n, bytes) cut by the anchors of another level, or into single windows after the last
    one: anchor, form, n as they were, and key, sub, off, bytes of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_buffers(batch.column(3))
            raw = memoryview(data)
            if level < LEVELS:
                row, key, first, last = contexts(data, ends, length, level)
                key = mix(key.view(np.uint64) ^ batch.column(0).to_numpy()[row].view(np.uint64)).view(np.int64)
            else:
                windows = np.maximum(np.diff(ends) - length + 1, 0)
                row = np.repeat(np.arange(len(batch)), windows)
                first = last = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
                key = None
            begin = ends[row] + first
            for a in range(0, len(row), 8192):
                part = slice(a, a + 8192)
                pieces = [raw[x : x + n].tobytes() for x, n in zip(begin[part].tolist(), (last[part] - first[part] + length).tolist(), strict=True)]
                sub = np.array([xxhash.xxh3_64_intdigest(p) for p in pieces], np.uint64).view(np.int64)
                of = [batch.column(k).take(pa.array(row[part])) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*of, pa.array(sub if key is None else key[part]), pa.array(sub), pa.array(first[part].astype(np.int32)), pa.array(pieces, pa.binary())], ["anchor", "form", "n", "key", "sub", "off", "bytes"])

    return forms.select("anchor", "form", "n", "bytes").mapInArrow(run, "anchor long, form long, n long, key long, sub long, off int, bytes binary")


def expand_crowds(forms: DataFrame, length: int, block: int, crowd: int, level: int = 1) -> DataFrame:
    """anchor, form, spans of contexts whose anchors have too many bytes for one task."""
    spark = forms.sparkSession
    parts = stored(spark, cut_anew(forms, length, level), "parts")
    finer = parts.groupBy(F.col("key").alias("anchor"), F.col("sub").alias("form")).agg(F.sum("n").alias("n"), F.first("bytes").alias("bytes"))
    finer = stored(spark, finer.withColumn("size", F.length("bytes") + 1), "finer")
    found = expand_sized(finer, length, block, crowd, level).select(F.col("anchor").alias("key"), F.col("form").alias("sub"), "spans")
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("off")).alias("a"), (s["b"] + F.col("off")).alias("b")))
    return parts.select("anchor", "form", "key", "sub", "off").join(found, ["key", "sub"]).groupBy("anchor", "form").agg(F.flatten(F.collect_list(moved)).alias("spans"))


def expand_sized(forms: DataFrame, length: int, block: int, crowd: int, level: int = 0) -> DataFrame:
    """anchor, form, spans of those contexts (anchor, form, n, bytes, size) that repeat, crowds apart; level: of the hash
    that chose these anchors.

    A window that is dealt out by its own hash meets only its equals, which are one context, so it is no crowd."""
    spark = forms.sparkSession
    sizes = forms.groupBy("anchor").agg(F.sum("size").alias("all")).where(F.col("all") > crowd).select("anchor")
    # Stored, so that its size is known: a short list goes to the contexts, which else would be dealt out by anchor here.
    hot = stored(spark, sizes, "hot") if level < LEVELS else None
    if hot is None or hot.isEmpty():
        return stored(spark, expand_contexts(forms, length, block).where("size(spans) > 0"), "expanded")
    found = expand_contexts(forms.join(hot, "anchor", "left_anti"), length, block).where("size(spans) > 0")
    crowds = forms.join(hot, "anchor", "left_semi").dropDuplicates(["anchor", "form"])
    return stored(spark, found, "expanded").union(expand_crowds(crowds, length, block, crowd, level + 1))


def repeated_spans(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """doc_id, hash, spans: the byte ranges [a, b) of each text that repeat, not merged; texts without any are absent.

    docs: doc_id, hash, text."""
    spark = docs.sparkSession
    every = stored(spark, scan_contexts(docs.select("doc_id", "hash", "text"), length), "contexts")
    # Stored, so that the join deals both sides anew and a frequent anchor's rows can be split.
    twice = stored(spark, every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "twice")
    some = stored(spark, every.join(twice, "anchor", "left_semi"), "repeated")
    one = F.struct("doc_id", "hash", "first", "last")
    forms = some.groupBy("anchor", "form").agg(F.count("*").alias("n"), F.min(one).alias("of"))
    asked = stored(spark, forms.groupBy("of.doc_id", "of.hash").agg(F.collect_list(F.struct("anchor", "form", "n", "of.first", "of.last")).alias("asked")), "asked")
    texts = docs.where(prefilter(asked.select(F.xxhash64("doc_id", "hash").alias("key"))).passes(F.xxhash64("doc_id", "hash")))
    sources = texts.join(asked, [texts["doc_id"].eqNullSafe(asked["doc_id"]), texts["hash"] == asked["hash"]]).select("asked", "text", asked["doc_id"], asked["hash"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked_, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
                raw, rows = text.as_py(), asked_.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in ("anchor", "form", "n")] + [pa.array([raw[r["first"] : r["last"] + length] for r in rows], pa.binary())], ["anchor", "form", "n", "bytes"])

    pieces = sources.select("asked", "text").mapInArrow(cut, "anchor long, form long, n long, bytes binary")
    pieces = stored(spark, pieces.withColumn("size", F.length("bytes") + 1), "pieces")  # equal rows of docs give equal pieces
    spans = expand_sized(pieces, length, block, crowd)
    places = some.join(spans, ["anchor", "form"]).select("doc_id", "hash", "first", F.explode("spans").alias("s"))
    ranges = places.select("doc_id", "hash", (F.col("first") + F.col("s.a")).alias("a"), (F.col("first") + F.col("s.b") + length).alias("b"))
    return ranges.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, crowd: int = CROWD, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (maximal removed ranges) and, if asked, the kept bytes."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "hash(text) hash", "text")  # the hash tells apart texts of one doc_id
    spans = stored(spark, repeated_spans(docs, length, block, crowd), "spans")
    may = prefilter(spans.select(F.xxhash64("doc_id", "hash").alias("key"))).passes(F.xxhash64("doc_id", "hash"))
    touched = docs.where(may).alias("d").join(spans.alias("s"), F.expr("d.doc_id <=> s.doc_id and d.hash = s.hash"), "left").select("d.doc_id", "d.text", "s.spans")
    rows = touched.union(docs.where(~may).select("doc_id", "text", F.lit(None).cast(_SPANS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * keep_text
        for batch in batches:
            sizes, gone, ranges, hashes, kept = [], [], [], [], []
            for text, asked in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, cuts = text or b"", merged(asked)
                left, at = [], 0
                for a, b in cuts:
                    left.append(text[at:a])
                    at = b
                left = b"".join([*left, text[at:]]) if cuts else text
                sizes.append(len(text))
                gone.append(len(text) - len(left))
                ranges.append(cuts)
                hashes.append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    kept.append(left)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(r) for r in ranges], pa.int64()), pa.array(hashes, pa.string()), _spans(ranges)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_text, names)

    schema = T.StructType().add("doc_id", "long").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("spans", _SPANS)
    return rows.mapInArrow(run, schema.add("kept", "binary") if keep_text else schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("spans")


#: The contract in SQL, over all windows in hexadecimal.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 199)) AS i, h FROM d WHERE length(h) >= 400),
k AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS a, md5(substr(h, 2 * i + 1, 400)) AS b FROM p),
q AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY a, b) > 1),
g AS (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS f FROM q)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, g),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM s),
u AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || any_value(substr(h, 2 * m + 1)) AS kept FROM t JOIN d USING (doc_id) JOIN (SELECT doc_id, max(b) AS m FROM s GROUP BY doc_id) USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN u USING (doc_id)"""
