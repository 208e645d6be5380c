"""Line dedup by a segment-partition edit join.

Lines are compared as bytes, A-Z lowered, without white space at the ends; empty lines are not compared. Two lines are
linked if their edit distance is at most edits_of() of the shorter one: one edit for each SHORT bytes, up to `edits`;
lines of less than SHORT bytes only if equal. Equal lines are one node, so copies cost one row each and never a pair.

A line s is cut into one segment more than its edits, all about as long. If a line t that is not shorter is linked with
s, some segment of s stands in t, starting at most a few bytes away from its own place; which places come into question
follows from the segment's number and the difference in length (multi-match-aware selection). Each line is indexed by
its segments under its own length, and probes the lengths down to its edits less with those few substrings. Lines that
meet under a key are first compared by a signature, 60 bits that say of which classes of byte pairs a line has an odd
number; an edit changes four at most. What is left is verified by a banded bit-parallel edit distance.

The 60 bits fall into 4 * edits + 1 sets, of which one at least is unchanged between linked lines. So the lines of a
larger key are compared within equal values of each set in turn, with no loss; a key with more than `crowd` lines is
dealt out again by those values, and what is still a crowd is cut into blocks of about crowd / 2 lines, of which every
two meet in a task of their own. So no task holds more than about `crowd` lines of a key, and only pairs that the
signature lets pass are written.

Classes are connected components of links; a class's first line is the one with the smallest doc_id, text hash
and line number. Defined results: null and empty texts have no lines; an empty table gives no rows. Rows with equal
doc_id and text are one document. Very long lines are compared whole. Only doc_id and text are read, so other columns
cannot clash; the pipeline stage carries them in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import prefilter
from .common import bounded_batches, mix, stored, table
from .graph import components

EDITS, SHORT, CROWD = 2, 12, 100_000
#: Lines whose keys a task remembers to have emitted.
SEEN = 500_000
#: Lines of one key that are compared each with each.
FEW = 256


def edits_of(size: int, edits: int) -> int:
    """The edits within which a line of this size is linked with longer ones."""
    return min(edits, size // SHORT)


def lines_of(text: bytes) -> list[bytes]:
    return [x.strip() for x in text.lower().split(b"\n")]


def segments(size: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments of a line of this size; the last ones may be a byte longer."""
    parts = edits + 1
    base, more = divmod(size, parts)
    lengths = [base + (k >= parts - more) for k in range(parts)]
    return [(sum(lengths[:k]), lengths[k]) for k in range(parts)]


_PLANS: dict[tuple[int, int], list[tuple[int, int, int]]] = {}


def plan_of(size: int, edits: int) -> list[tuple[int, int, int]]:
    """(seed, start, end) of the substrings that a line of this size is found under or looks for."""
    found = _PLANS.get((size, edits))
    if found is None:
        found = []
        for less in range(edits + 1):
            own = edits_of(size - less, edits)
            if size - less < SHORT or less > own:
                break
            for k, (start, n) in enumerate(segments(size - less, own)):
                low = max(start - k, start + less - (own - k), 0)
                high = min(start + k, start + less + (own - k), size - n)
                found += [((size - less) * (edits + 1) + k, p, p + n) for p in range(low, high + 1)]
        if len(_PLANS) < 20_000:
            _PLANS[size, edits] = found
    return found


#: Bits of a signature; above them stand the line's own edits.
BITS = 60
_BITS = np.uint64((1 << BITS) - 1)


def signatures(lines: list[bytes], edits: int = EDITS) -> np.ndarray:
    """60 bits for each line, of which classes of pairs of neighbouring bytes it has an odd number, and its edits_of()."""
    sizes = np.array([len(x) for x in lines], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(lines), np.uint8).astype(np.uint64)
    after = np.concatenate([data[1:], data[:1]])
    spread = ((data << np.uint64(8) | after) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    bit = np.uint64(1) << (spread * np.uint64(BITS) >> np.uint64(32))
    bit[starts + sizes - 1] = 0  # a line's last byte has no neighbour
    own = np.minimum(edits, sizes // SHORT).astype(np.uint64)
    return np.bitwise_xor.reduceat(bit, starts) | own << np.uint64(BITS)


def _may(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the signatures (broadcast together) allow a link: four bits for each edit of the shorter line."""
    return np.bitwise_count((a ^ b) & _BITS) <= 4 * (np.minimum(a, b) >> np.uint64(BITS))


def sets_of(edits: int) -> list[tuple[int, int]]:
    """(first bit, end) of the sets of which linked lines have one in common: more than the bits that edits change."""
    n = 4 * edits + 1
    return [(BITS * k // n, BITS * (k + 1) // n) for k in range(n)]


def edit_distance(a: bytes, b: bytes, most: int) -> int:
    """The edit distance, or most + 1 where it is larger: bit-parallel over the band of 2 * most + 1 diagonals."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    same = len(commonprefix((a, b)))
    a, b = a[same:], b[same:]
    same = len(commonprefix((a[::-1], b[::-1])))
    a, b = (a[:-same], b[:-same]) if same else (a, b)
    if len(a) > len(b):
        a, b = b, a
    if len(a) <= most:
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return min(row[-1], most + 1)
    width = 2 * most + 1
    full = (1 << width) - 1
    up, down, distance = full & ~((1 << most) - 1), 0, most
    turn = len(a) - most
    for j, c in enumerate(b):
        match = 0
        for k in range(max(0, most - j), min(width, len(a) - j + most)):
            if a[j - most + k] == c:
                match |= 1 << k
        zero = ((((match & up) + up) ^ up) | match | down) & full
        plus, minus = (down | ~(zero | up)) & full, zero & up
        if j < turn:
            distance += not zero >> (width - 1)
        else:
            place = width - 2 - (j - turn)
            distance += (plus >> place & 1) - (minus >> place & 1)
        up, down = (minus | ~(zero >> 1 | plus)) & full, zero >> 1 & plus
        if distance > 3 * most:
            break
    return min(distance, most + 1)


def scan_lines(docs: DataFrame) -> DataFrame:
    """For each row its lines that are not empty: doc_id, hash, nos, sizes, lines (128-bit hashes), again (a line that
    the text had before). docs: doc_id, hash, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, no, size, line, again = [0], [], [], [], []
            for text in batch.column(2).cast(pa.large_binary()).to_pylist():
                before: set[bytes] = set()
                for k, x in enumerate(lines_of(text) if text else ()):
                    if x:
                        h = xxhash.xxh3_128_digest(x)
                        no.append(k)
                        size.append(len(x))
                        line.append(h)
                        again.append(h in before)
                        before.add(h)
                ends.append(len(no))
            ends_ = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends_, pa.array(v, t)) for v, t in ((no, pa.int32()), (size, pa.int32()), (line, pa.binary()), (again, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "hash", "nos", "sizes", "lines", "again"])

    return docs.mapInArrow(run, "doc_id long, hash long, nos array<int>, sizes array<int>, lines array<binary>, again array<boolean>")


def flat(lines: DataFrame) -> DataFrame:
    """doc_id, hash, no, size, line, again: a row for each line of scan_lines()."""
    each = F.explode(F.arrays_zip("nos", "sizes", "lines", "again")).alias("x")
    return lines.select("doc_id", "hash", each).select("doc_id", "hash", F.col("x.nos").alias("no"), F.col("x.sizes").alias("size"), F.col("x.lines").alias("line"), F.col("x.again").alias("again"))


def scan_keys(docs: DataFrame, edits: int) -> DataFrame:
    """key, line (Spark's xxhash64 of its hash), marks (its signature): where each different line is found, and where it looks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            fresh: dict[bytes, bytes] = {}
            for text in batch.column(0).cast(pa.large_binary()).to_pylist():
                for x in lines_of(text) if text else ():
                    if len(x) >= SHORT and (h := xxhash.xxh3_128_digest(x)) not in seen:
                        seen.add(h)
                        fresh[h] = x
            if len(seen) > SEEN:
                seen = set()
            hashes, lines = list(fresh), list(fresh.values())
            for first in range(0, len(lines), 4096):
                part = lines[first : first + 4096]
                keys, n = [], []
                for x in part:
                    plan = plan_of(len(x), edits)
                    keys += [xxhash.xxh3_64_intdigest(x[a:b], s) for s, a, b in plan]
                    n.append(len(plan))
                ids = np.array([xxhash.xxh64_intdigest(h, 42) for h in hashes[first : first + 4096]], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.repeat(ids, n)), pa.array(np.repeat(signatures(part, edits).view(np.int64), n))], ["key", "line", "marks"])

    return docs.select("text").mapInArrow(run, "key long, line long, marks long")


def _close(marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (first, later) of pairs whose signatures allow a link."""
    for first in range(0, len(marks), 256):
        x, y = np.nonzero(_may(marks[first : first + 256, None], marks[None, first:]))
        later = y > x
        if later.any():
            yield first + x[later], first + y[later]


def _set_values(marks: np.ndarray, low: int, high: int) -> np.ndarray:
    return marks >> np.uint64(low) & np.uint64((1 << (high - low)) - 1)


def meet(keys: DataFrame, edits: int, crowd: int | None, refine: bool = False) -> DataFrame:
    """kind, a, b, c: pairs (0, line, line, -) whose signatures allow a link; rows of crowds (1, key, line, marks), with
    keys that also say the value of a set of bits if `refine`."""
    sets = sets_of(edits)

    def rows(kind: int, a, b, c) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(c)], ["kind", "a", "b", "c"])

    def found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return rows(0, a, b, np.zeros(len(a), np.int64))

    def crowded(key: int, line: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not refine:
            yield rows(1, np.full(len(line), key), line, marks.view(np.int64))
            return
        for s, (low, high) in enumerate(sets):
            fine = mix(mix(_set_values(marks, low, high) + np.uint64(s << 32)) + np.array([key]).view(np.uint64))
            yield rows(1, fine.view(np.int64), line, marks.view(np.int64))

    def group(line: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        line, which = np.unique(line, return_index=True)
        marks = marks[which]
        if len(line) <= FEW:
            for a, b in _close(marks):
                yield found(line[a], line[b])
            return
        for s, (low, high) in enumerate(sets):
            value = _set_values(marks, low, high)
            order = np.argsort(value, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
                if len(at) > 1:
                    for a, b in _close(marks[at]):
                        a, b = at[a], at[b]
                        differ = marks[a] ^ marks[b]
                        new = np.ones(len(a), bool)  # a pair counts in the first set that it has in common
                        for before in sets[:s]:
                            new &= _set_values(differ, *before) != 0
                        if new.any():
                            yield found(line[a[new]], line[b[new]])

    def pairs(key: np.ndarray, line: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[begin, len(key)])
        two = begin[size == 2]  # most groups that matter
        two = two[(line[two] != line[two + 1]) & _may(marks[two], marks[two + 1])] if len(two) else two
        if len(two):
            yield found(np.minimum(line[two], line[two + 1]), np.maximum(line[two], line[two + 1]))
        for k in np.flatnonzero(size > 2).tolist():
            at = slice(begin[k], begin[k] + size[k])
            yield from group(line[at], marks[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        crowd_key = None  # rows of a key that turned out a crowd are handed on as they come
        for batch in batches:
            now = [np.concatenate([h, c.to_numpy().view(h.dtype)]) for h, c in zip(held, batch.columns, strict=True)]
            if crowd_key is not None and len(now[0]):
                same = int(np.searchsorted(now[0], crowd_key, "right"))
                if same:
                    yield from crowded(crowd_key, now[1][:same], now[2][:same])
                now = [x[same:] for x in now]
            if not len(now[0]):
                held = now
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if cut:
                yield from pairs(now[0][:cut], now[1][:cut], now[2][:cut])
            held = [x[cut:] for x in now]
            if crowd is not None and len(held[0]) > crowd:
                crowd_key = int(held[0][0])
                yield from crowded(crowd_key, held[1], held[2])
                held = [x[:0] for x in held]
        if len(held[0]):
            yield from pairs(*held)

    parts = max(8, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return keys.select("key", "line", "marks").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "kind int, a long, b long, c long")


def _again(met: DataFrame) -> DataFrame:
    """The rows of crowds of meet(), as keys; a line that a key has twice counts once."""
    return met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("line"), F.col("c").alias("marks")).distinct()


def in_blocks(keys: DataFrame, crowd: int) -> DataFrame:
    """keys whose lines are dealt into blocks of about crowd / 2, with a new key for every two blocks of one key."""
    n = keys.groupBy("key").agg(F.ceil(F.count("*") / (crowd / 2)).cast("int").alias("blocks"))
    rows = keys.join(n, "key").withColumn("mine", F.pmod(F.xxhash64("line", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "line", "marks")


def line_links(docs: DataFrame, lines: DataFrame, edits: int = EDITS, crowd: int = CROWD) -> DataFrame:
    """(u, v) with u < v: different lines that are linked. docs: doc_id, hash, text; lines: of flat()."""
    if not 0 <= edits <= 12:
        raise ValueError("the signature's bits are told apart for at most twelve edits")
    spark = docs.sparkSession
    met = stored(spark, meet(scan_keys(docs, edits), edits, crowd, refine=True), "met")
    pairs = met.where("kind = 0").select("a", "b")
    crowds = _again(met)
    if not crowds.isEmpty():
        met = stored(spark, meet(crowds, edits, crowd), "met")
        pairs = pairs.union(met.where("kind = 0").select("a", "b"))
        left = stored(spark, _again(met), "crowds")
        if not left.isEmpty():
            pairs = pairs.union(meet(in_blocks(left, crowd), edits, None).select("a", "b"))
    pairs = stored(spark, pairs.distinct(), "pairs")
    asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    asked = stored(spark, asked, "asked")
    known = lines.where(F.col("size") >= SHORT).withColumn("id", F.xxhash64("line")).where(prefilter(asked.select(F.col("id").alias("key"))).passes(F.col("id")))
    known = known.groupBy("id", "line").agg(F.min(F.struct("doc_id", "hash", "no")).alias("of")).join(asked, "id", "left_semi")
    by_text = stored(spark, known.groupBy("of.doc_id", "of.hash").agg(F.collect_list(F.struct("id", "line", "of.no")).alias("asked")), "by_text")
    texts = docs.where(prefilter(by_text.select(F.col("hash").alias("key"))).passes(F.col("hash")))
    sources = texts.alias("d").join(by_text.alias("s"), F.expr("d.doc_id <=> s.doc_id and d.hash = s.hash")).select("s.asked", "d.text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked_, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                every = lines_of(text)
                yield pa.RecordBatch.from_arrays([pa.array([r["id"] for r in asked_], pa.int64()), pa.array([r["line"] for r in asked_], pa.binary()), pa.array([every[r["no"]] for r in asked_], pa.binary())], ["id", "line", "bytes"])

    wanted = stored(spark, sources.mapInArrow(cut, "id long, line binary, bytes binary").dropDuplicates(["line"]), "lines")
    left = wanted.select(F.col("id").alias("a"), F.col("line").alias("u"), F.col("bytes").alias("x"))
    right = wanted.select(F.col("id").alias("b"), F.col("line").alias("v"), F.col("bytes").alias("y"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                most = edits_of(min(len(x), len(y)), edits)
                keep.append(edit_distance(x, y, most) <= most)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "x", "y").mapInArrow(verify, "u binary, v binary").distinct()


def classify(docs: DataFrame, edits: int = EDITS, crowd: int = CROWD) -> DataFrame:
    """For each row of docs: doc_id, hash, nos and sizes of its lines that are not empty, and `marked`, those of them
    whose class has other lines, as (no, size, links, first_doc, first_hash, first_no, docs): how many different
    lines a line is linked with, where its class stands first, and in how many documents each of the class's
    different lines stands, added up. docs: doc_id, hash, text."""
    spark = docs.sparkSession
    lines = stored(spark, scan_lines(docs), "lines")
    every = flat(lines)
    links = stored(spark, line_links(docs, every, edits, crowd), "links")
    both = links.select(F.col("u").alias("line")).union(links.select("v")).groupBy("line").agg(F.count("*").alias("links"))
    linked = stored(spark, components(links).withColumnRenamed("node", "line").join(both, "line"), "linked")
    # Lines that no filter stops are joined; all others are their own class.
    may = prefilter(linked.select(F.col("line").alias("key"))).passes(F.col("line"))
    columns = ["doc_id", "hash", "no", "size", "again"]
    rows = every.where(~may).select(*columns, F.col("line").alias("class"), F.lit(0).cast("long").alias("links"))
    rows = rows.union(every.where(may).join(linked, "line", "left").select(*columns, F.coalesce("root", "line"), F.coalesce("links", F.lit(0))))
    shape = rows.groupBy("class").agg(F.min(F.struct("doc_id", "hash", "no")).alias("first"), F.count_if(~F.col("again")).alias("docs"), F.count("*").alias("n")).where("n > 1").drop("n")
    shape = stored(spark, shape, "shape")
    some = rows.where(prefilter(shape.select(F.col("class").alias("key"))).passes(F.col("class"))).join(shape, "class")
    one = F.struct("no", "size", "links", F.col("first.doc_id").alias("first_doc"), F.col("first.hash").alias("first_hash"), F.col("first.no").alias("first_no"), "docs")
    marked = some.groupBy("doc_id", "hash").agg(F.sort_array(F.collect_set(one)).alias("marked"))
    found = lines.select("doc_id", "hash", "nos", "sizes").alias("d").join(marked.alias("m"), F.expr("d.doc_id <=> m.doc_id and d.hash = m.hash"), "left")
    return found.select("d.doc_id", "d.hash", "d.nos", "d.sizes", F.coalesce("m.marked", F.array().cast(marked.schema["marked"].dataType)).alias("marked"))


def prepared(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) hash", "text")


def line_classes(docs: DataFrame, edits: int = EDITS, crowd: int = CROWD) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines (not empty), n_repeats (lines that are not the first of their
    class), n_links (links of its lines with different lines) and line_class (the doc_id where each line's class
    stands first)."""
    bounded_batches(docs.sparkSession)
    rows = classify(prepared(docs), edits, crowd)
    first = "x -> not (x.first_doc <=> doc_id and x.first_hash = hash and x.first_no = x.no)"
    rows = rows.withColumn("of", F.map_from_arrays("marked.no", "marked.first_doc"))
    return rows.select(
        "doc_id",
        F.size("nos").cast("long").alias("n_lines"),
        F.expr(f"cast(size(filter(marked, {first})) as long)").alias("n_repeats"),
        F.expr("aggregate(marked, 0L, (s, x) -> s + x.links)").alias("n_links"),
        F.expr("transform(nos, no -> if(map_contains_key(of, no), of[no], doc_id))").alias("line_class"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(table(spark, sf_dir, "documents"))


#: Two documents are near copies if each has at least this percentage of its bytes in lines that the other has too.
COPY = 80


def _document(doc_id: int | None, text_hash: int) -> tuple:
    """A document in the order in which classes choose their first line (null ids come first)."""
    return doc_id is not None, doc_id or 0, text_hash


def _place(line: dict) -> tuple:
    return line["first_doc"], line["first_hash"], line["first_no"]


def possible_sources(doc_id: int | None, text_hash: int, sizes: list[int], marked: list[dict]) -> list[tuple]:
    """The (doc_id, hash) of the documents where classes of this one stand first and of which it may be a near copy:
    what it shares with a document stands first there or earlier."""
    shared: dict[tuple, int] = {}
    for x in marked:
        shared[x["first_doc"], x["first_hash"]] = shared.get((x["first_doc"], x["first_hash"]), 0) + x["size"]
    found, upto = [], 0
    for source in sorted(shared, key=lambda s: _document(*s)):
        upto += shared[source]
        if source != (doc_id, text_hash) and 100 * upto >= COPY * sum(sizes):
            found.append(source)
    return found


def near_copies(sizes: list[int], marked: list[dict], other_sizes: list[int], other_marked: list[dict]) -> bool:
    mine, theirs = {_place(x) for x in marked}, {_place(x) for x in other_marked}
    common = sum(x["size"] for x in marked if _place(x) in theirs)
    other_common = sum(x["size"] for x in other_marked if _place(x) in mine)
    return 100 * common >= COPY * sum(sizes) and 100 * other_common >= COPY * sum(other_sizes)


def lines_to_remove(doc_id: int | None, text_hash: int, sizes: list[int], marked: list[dict], copied: list[tuple] | None = None) -> list[int]:
    """Numbers of the lines that the stage takes out of a document.

    A line goes if its class has an earlier line, in the same document or in another one, however many documents or
    lines share. Only what stands first in a document that this one is a near copy of (`copied`: their doc_id and
    hash; if not given, all that this document's own lines allow) is left to near-duplicate detection."""
    if copied is None:
        copied = possible_sources(doc_id, text_hash, sizes, marked)
    gone: list[int] = []
    seen: set[tuple] = set()
    for x in marked:
        place = _place(x)
        if place in seen or place[:2] != (doc_id, text_hash) and place[:2] not in copied:
            gone.append(x["no"])
        seen.add(place)
    return sorted(gone)


def copies(found: DataFrame) -> DataFrame:
    """doc_id, hash, copied: the documents that each near copy is a near copy of. found: doc_id, hash, sizes, marked."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, doc, digest = [], [], []
            for k, row in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                for d, h in possible_sources(*row):
                    at.append(k)
                    doc.append(d)
                    digest.append(h)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(doc, pa.int64()), pa.array(digest, pa.int64())], ["doc_id", "hash", "sizes", "marked", "of", "of_hash"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [near_copies(*row) for row in zip(*(batch.column(k).to_pylist() for k in range(4, 8)), strict=True)]
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    schema = found.select("doc_id", "hash", "sizes", "marked").schema
    asked = found.select("doc_id", "hash", "sizes", "marked").dropDuplicates(["doc_id", "hash"]).mapInArrow(ask, schema.add("of", "long").add("of_hash", "long"))
    sources = found.dropDuplicates(["doc_id", "hash"])
    both = asked.alias("d").join(sources.alias("s"), F.expr("d.of <=> s.doc_id and d.of_hash = s.hash"))
    both = both.select("d.doc_id", "d.hash", "d.of", "d.of_hash", "d.sizes", "d.marked", F.col("s.sizes").alias("other_sizes"), F.col("s.marked").alias("other_marked"))
    kept = both.mapInArrow(compare, "doc_id long, hash long, of long, of_hash long")
    return kept.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("of", "of_hash")).alias("copied"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines go (see lines_to_remove); every document stays, n_chars follows the text."""
    bounded_batches(spark)
    found = stored(spark, classify(prepared(docs)).where("size(marked) > 0").select("doc_id", "hash", "sizes", "marked"), "found")
    copied = F.coalesce("c.copied", F.expr("cast(array() as array<struct<of: bigint, of_hash: bigint>>)"))
    found = found.alias("f").join(copies(found).alias("c"), F.expr("f.doc_id <=> c.doc_id and f.hash = c.hash"), "left").select("f.doc_id", "f.hash", "f.sizes", "f.marked", copied.alias("copied"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [lines_to_remove(*row, [(c["of"], c["of_hash"]) for c in near]) for *row, near in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], ["of", "hash", "gone"])
            yield out.filter(pa.array([bool(g) for g in gone], pa.bool_()))

    cuts = stored(spark, found.mapInArrow(choose, "of long, hash long, gone array<int>").dropDuplicates(["of", "hash"]), "cuts")
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text")
    may = prefilter(cuts.select(F.col("hash").alias("key"))).passes(F.col("hash"))
    joined = rows.where(may).alias("d").join(cuts.alias("c"), F.expr("d.id <=> c.of and d.hash = c.hash"), "left").select("d.doc", "d.text", "c.gone")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if gone:
                    cut = set(gone)
                    text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in cut)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc", "text"])

    changed = joined.mapInArrow(rewrite, joined.select("doc", "text").schema).union(rows.where(~may).select("doc", "text"))
    columns = []
    for c in docs.columns:
        value = F.col("text") if c == "text" else F.col("doc")[c]
        if c == "n_chars":
            value = F.when(F.col("text") == F.col("doc")["text"], value).otherwise(F.length("text")).cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    return changed.select(*columns)
