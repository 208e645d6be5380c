"""MinHash near-duplicate detection with an LSH forest, confirmed on full shingle sets.

A document's set is its distinct 5-word shingles (A-Z lowered; words are runs of anything but space and the
bytes 9 to 13). Equal sets are one node. Each tree of the forest is an order of all nodes, sorted by DEPTH MinHash
values of its own; neighbours in an order whose longest common prefix is at least the region's depth are candidates.
The depth is DEPTH, and SHALLOW in regions (runs with SHALLOW values in common) of at most SPARSE nodes. Orders are
dealt out by ranges of the whole key, so a region of any size is split, and runs that touch a range's ends are walked
once more over all ranges' ends. Linking neighbours costs one row a node and order, however many nodes stand together.

Candidates join nodes into families; within a family every pair that may still join two components is compared on the
full sets, by counts over an inverted index, so a link is decided exactly: 100 * intersection >= percent * union. A
member is looked up by its rarest shingles alone, so many of them that a linked set must have one, where that is less.

A family of at most FAMILY shingles is settled in one task. A larger one is never gathered: in rounds, pivots
(nodes outside the family's largest component, of at most FAMILY shingles a round) are compared with all its nodes in
salted blocks, until every node outside the largest component has been a pivot. Then no link between components is left.

A pair at similarity s shares a DEPTH prefix in none of n orders with probability (1 - s^4)^n, and no region is ever
deeper. The number of orders follows from `percent`, so that this is at most MISS = 1e-5 for a pair that just makes it:
16 orders at 0.85, 22 at 0.80. That is the only way in which a link can be missed.

Defined results: null text, or text without words, has an empty set and is linked with nothing. Fewer than five
words are one shingle. Very long texts are read whole, at some thirty times their size in memory. Equal doc_ids are one
document where component ids are concerned; repeated rows each give a row. Null doc_ids get null components and are
kept. Ties: nodes with equal keys stand in the order of their hash. An empty table gives no rows. Only doc_id and text
are read, so other columns cannot clash; the pipeline stage passes them through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import prefilter
from .common import LOWER, UPPER, bounded_batches, mix, stored, table, text_buffers
from .graph import components

WORDS, PERCENT = 5, 85
#: Values in common that make neighbours candidates, and those that do in regions of so few nodes.
DEPTH, SHALLOW, SPARSE = 4, 3, 4
#: The chance to miss a pair that just makes it.
MISS = 1e-5
#: Shingles that one task settles at once, and pivots of the first round; each later round has twice as many.
FAMILY, PIVOTS = 4_000_000, 64
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_NODE = "node binary"


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets): the sorted distinct 64-bit shingle codes of each text, one text after the other."""
    texts = len(ends) - 1
    data = _LOWER[data]
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = ends[:-1][np.diff(ends) > 0]
    first[edges] |= inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    # A word's code: its bytes times one random odd factor for each place, summed.
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.r_[starts, len(data)])) if starts[0] == 0 else np.r_[np.zeros(starts[0], np.int64), np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.r_[starts, len(data)]))]
    longest = int(place.max()) + 1
    factors = mix(np.arange(1, longest + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    each = (data.astype(np.uint64) + np.uint64(1)) * factors[place]
    each[~inside] = 0
    word = mix(np.add.reduceat(each, starts))
    per_text = np.searchsorted(starts, ends)
    n_words = np.diff(per_text)
    n_shingles = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    at = np.concatenate([[0], np.cumsum(n_shingles)])
    text = np.repeat(np.arange(texts), n_shingles)
    begin = per_text[text] + np.arange(at[-1]) - at[text]
    code = np.zeros(at[-1], np.uint64)
    size = np.minimum(n_words, words)[text]
    for k in range(words):
        on = size > k
        code = np.where(on, mix(code * np.uint64(0xD6E8FEB86659FD93) + word[np.minimum(begin + k, len(word) - 1)]), code)
    order = np.lexsort((code, text))
    code, text = code[order], text[order]
    new = np.r_[True, (code[1:] != code[:-1]) | (text[1:] != text[:-1])] if len(code) else np.zeros(0, bool)
    code, text = code[new], text[new]
    return code, np.searchsorted(text, np.arange(texts + 1))


def signatures(code: np.ndarray, at: np.ndarray, hashes: int) -> np.ndarray:
    """(texts, hashes) MinHash values of 32 bits; zeros for an empty set."""
    out = np.zeros((len(at) - 1, hashes), np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        seeds = mix(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        for k in range(hashes):
            value = code * seeds[k]
            value ^= value >> np.uint64(29)
            value *= np.uint64(0xE7037ED1A0B428DB)
            out[full, k] = np.minimum.reduceat((value >> np.uint64(32)).astype(np.uint32), at[full])
    return out


def _parts(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, ends = text_buffers(column)
    first = 0
    for i in range(len(column)):
        if ends[i + 1] - ends[first] > limit or i + 1 == len(column):
            yield first, i + 1, data[ends[first] : ends[i + 1]], ends[first : i + 2] - ends[first]
            first = i + 1


def orders(percent: int) -> int:
    """So many orders that a pair at this similarity is missed with probability MISS at most."""
    share = (percent / 100) ** DEPTH
    return 1 if share >= 1 else math.ceil(math.log(MISS) / math.log1p(-share))


def sketch(docs: DataFrame, trees: int) -> DataFrame:
    """doc_id, n_shingles, node (a 128-bit hash of the set, null if empty), keys (the MinHash values, tree by tree)."""
    hashes = trees * DEPTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, ends in _parts(batch.column(1)):
                code, at = shingle_sets(data, ends)
                raw, keys = code.tobytes(), signatures(code, at, hashes)
                size = np.diff(at)
                nodes = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                packed = keys.tobytes()
                rows = [packed[k * hashes * 4 : (k + 1) * hashes * 4] if n else None for k, n in enumerate(nodes)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(size, pa.int64()), pa.array(nodes, pa.binary()), pa.array(rows, pa.binary())], ["doc_id", "n_shingles", "node", "keys"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, f"doc_id long, n_shingles long, {_NODE}, keys binary")


def walk(prefixes: np.ndarray, first: bool, last: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Of sorted rows of DEPTH values (their tree in front): the rows linked with the row before, the run of each row,
    and the number of runs. first, last: the first, the last run may go on elsewhere, so it counts as no sparse region."""
    same = np.cumprod(prefixes[1:] == prefixes[:-1], axis=1).sum(axis=1) - 1  # values in common; -1: another tree
    run = np.concatenate([[0], np.cumsum(same < SHALLOW)])
    size = np.bincount(run)
    if first:
        size[0] = SPARSE + 1
    if last:
        size[-1] = SPARSE + 1
    link = (same >= DEPTH) | (same >= SHALLOW) & (size[run[1:]] <= SPARSE)
    return np.flatnonzero(link) + 1, run, len(size)


def candidate_edges(nodes: DataFrame, trees: int) -> DataFrame:
    """(u, v) between neighbours of the forest's orders. nodes: node, keys."""
    spark = nodes.sparkSession
    size = 4 * DEPTH
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    rows = nodes.select("node", F.explode(F.transform(numbers, lambda t: F.struct(t.alias("tree"), F.substring(F.col("keys"), (t * size + 1).cast("int"), F.lit(size)).alias("key")))).alias("t"))
    rows = rows.select("t.tree", "t.key", "node")
    names = ["tree", "key", "node", "other"]

    def walker(whole: bool):
        """Edges as (-, -, node, other). Unless it is the whole order, the ends of the runs at its ends as (tree, key, node, -)."""

        def edges(batch: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
            node = batch.column(2)
            none = pa.nulls(len(at), pa.int32())
            return pa.RecordBatch.from_arrays([none, pa.nulls(len(at), pa.binary()), node.take(pa.array(at)), node.take(pa.array(at - 1))], names)

        def ends(batch: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
            found = batch.take(pa.array(at))
            return pa.RecordBatch.from_arrays([*found.columns, pa.nulls(len(at), pa.binary())], names)

        def values(batch: pa.RecordBatch) -> np.ndarray:
            key = batch.column(1)
            raw = np.frombuffer(b"".join(key.to_pylist()), np.uint32).reshape(-1, DEPTH)
            return np.concatenate([batch.column(0).to_numpy()[:, None].astype(np.uint32), raw], axis=1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: pa.RecordBatch | None = None
            first = not whole  # whether the first run of the rows at hand may go on in the range before
            for batch in batches:
                if not len(batch):
                    continue
                if held is not None:
                    batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                at, runs, n = walk(values(batch), first, True)
                yield edges(batch, at)
                open_ = np.flatnonzero(runs == n - 1)  # the last run may go on; its last rows tell all that matters
                if first and n > 1:
                    yield ends(batch, np.flatnonzero(runs == 0)[-(SPARSE + 1) :])
                    yield ends(batch, np.flatnonzero(runs == 0)[: SPARSE + 1])
                    first = False
                elif first:
                    yield ends(batch, open_[: SPARSE + 1])
                held = batch.take(pa.array(open_[-(SPARSE + 1) :]))
            if held is not None:
                at, runs, _ = walk(values(held), first, not whole)
                yield edges(held, at)
                if not whole:
                    yield ends(held, np.arange(len(held)))

        return run

    schema = "tree int, key binary, node binary, other binary"
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = rows.repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions("tree", "key", "node").mapInArrow(walker(False), schema)
    found = stored(spark, found, "neighbours")
    # A range has at most 4 * (SPARSE + 1) such rows, so they are few, whatever the table's size.
    borders = found.where("other is null").select("tree", "key", "node").distinct().coalesce(1).sortWithinPartitions("tree", "key", "node").mapInArrow(walker(True), schema)
    return found.where("other is not null").union(borders).select(F.col("node").alias("u"), F.col("other").alias("v"))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted's columns with `codes`, the shingle set, from the texts of documents (doc_id, text hash) that stand for their nodes."""
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    texts = texts.where(prefilter(wanted.select(F.col("doc_id").alias("key"))).passes(F.col("doc_id")))  # else all texts would be shuffled
    texts = texts.join(wanted, "doc_id").select("node", "family", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, ends in _parts(batch.column(2)):
                code, at = shingle_sets(data, ends)
                raw = code.tobytes()
                codes = [raw[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                node = batch.column(0).slice(first, last - first)
                right = pa.array([xxhash.xxh3_128_digest(c) == n for c, n in zip(codes, node.to_pylist(), strict=True)])  # equal ids may have other texts
                out = pa.RecordBatch.from_arrays([node, batch.column(1).slice(first, last - first), pa.array(codes, pa.binary())], ["node", "family", "codes"])
                yield out.filter(right)

    return texts.mapInArrow(run, f"{_NODE}, family binary, codes binary").dropDuplicates(["family", "node"])


class FamilyIndex:
    """The sets of a family with an inverted index over their shingles."""

    def __init__(self, sets: list[bytes]) -> None:
        codes = [np.frombuffer(s, np.uint64) for s in sets]
        self.size = np.array([len(c) for c in codes], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        _, token = np.unique(np.concatenate(codes), return_inverse=True)
        self.token = token
        order = np.argsort(token, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.size)[order]
        self.first = np.searchsorted(token[order], np.arange(int(token.max()) + 2))
        self.marked = np.zeros(len(self.first), bool)

    def linked(self, k: int, percent: int) -> np.ndarray:
        """The members whose similarity with member k is at least percent / 100."""
        mine, n = self.token[self.at[k] : self.at[k + 1]], int(self.size[k])
        often = self.first[mine + 1] - self.first[mine]
        must = n - -(-percent * n // 100) + 1  # of so many shingles a linked set has one
        if must < n:
            order = np.argsort(often, kind="stable")
            rare = order[:must]
            if 8 * int(often[rare].sum()) < int(often.sum()):  # then at most half as many to add up
                asked = np.unique(self._owners(mine[rare]))
                fits = (100 * self.size[asked] >= percent * n) & (100 * n >= percent * self.size[asked])
                asked = asked[fits]
                size = self.size[asked]
                if int(size.sum()) < int(often.sum()):
                    self.marked[mine] = True
                    place = np.repeat(self.at[asked] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    shared = np.add.reduceat(self.marked[self.token[place]].astype(np.int64), np.cumsum(size) - size)
                    self.marked[mine] = False
                    return asked[100 * shared >= percent * (n + size - shared)]
        shared = np.bincount(self._owners(mine), minlength=len(self.size))
        return np.flatnonzero(100 * shared >= percent * (n + self.size - shared))

    def _owners(self, tokens: np.ndarray) -> np.ndarray:
        """The members that have each of these shingles, one after the other."""
        a, n = self.first[tokens], self.first[tokens + 1] - self.first[tokens]
        return self.owner[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]


def settle(sets: list[bytes], percent: int = PERCENT) -> list[int]:
    """For each set, the smallest position in its component of exact links."""
    index = FamilyIndex(sets)
    label = np.full(len(sets), -1)
    left = len(sets)
    for seed in range(len(sets)):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        left -= 1
        queue = [seed]
        while queue and left:
            for k in index.linked(queue.pop(), percent):
                if label[k] < 0:
                    label[k] = seed
                    left -= 1
                    queue.append(int(k))
    return label.tolist()


def _settle_families(sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): each node and the first of its component, for families of bounded size."""

    def done(nodes: list[bytes], codes: list[bytes]) -> pa.RecordBatch:
        order = sorted(range(len(nodes)), key=lambda k: nodes[k])
        nodes = [nodes[k] for k in order]
        label = settle([codes[k] for k in order], percent) if len(nodes) > 1 else [0] * len(nodes)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([nodes[k] for k in label], pa.binary())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, nodes, codes = None, [], []
        for batch in batches:
            for f, n, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if f != family and nodes:
                    yield done(nodes, codes)
                    nodes, codes = [], []
                family = f
                nodes.append(n)
                codes.append(c)
        if nodes:
            yield done(nodes, codes)

    parts = max(8, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sets.select("family", "node", "codes").repartition(parts, "family").sortWithinPartitions("family").mapInArrow(run, "u binary, v binary")


def _settle_large(sets: DataFrame, percent: int, family: int) -> DataFrame:
    """(u, v) links that join the components of families too large for one task, by rounds of pivots.

    A round's pivots are chosen by hash, about per_round of a family and of about `family` shingles at most."""
    spark = sets.sparkSession
    sets = stored(spark, sets.select("family", "node", "codes", (F.length("codes") / 8).cast("long").alias("n")), "large")
    bodies = sets.select("family", "node", "codes")
    shape = sets.groupBy("family").agg(F.sum("n").alias("size")).withColumn("salts", F.ceil(F.col("size") / (family / 4)).cast("int")).checkpoint()
    salted = bodies.join(shape.select("family", "salts"), "family").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))
    links = sets.select(F.col("node").alias("u"), F.col("node").alias("v"))
    asked = None
    per_round, turn = PIVOTS, 0

    def compare(key, members, pivots):
        import pandas as pd

        found = []
        if len(members) and len(pivots):
            index = FamilyIndex([*pivots["codes"], *members["codes"]])
            n = len(pivots)
            for k in range(n):
                found += [(pivots["node"].iloc[k], members["node"].iloc[j - n]) for j in index.linked(k, percent).tolist() if j >= n]
        return pd.DataFrame(found, columns=["u", "v"])

    while True:
        label = components(links).withColumnRenamed("root", "comp") if asked is not None else sets.select("node", F.col("node").alias("comp"))
        state = sets.select("family", "node", "n").join(label, "node")
        size = state.groupBy("family", "comp").agg(F.count("*").alias("m"))
        largest = size.groupBy("family").agg(F.max_by("comp", F.struct("m", "comp")).alias("top"), F.count("*").alias("comps"))
        rest = state.join(largest, "family").where((F.col("comps") > 1) & (F.col("comp") != F.col("top"))).select("family", "node", "n")
        if asked is not None:
            rest = rest.join(asked, "node", "left_anti")
        rest = stored(spark, rest.withColumn("h", F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 40))), "rest")
        left = rest.groupBy("family").agg(F.min("h").alias("least"), F.least(F.lit(per_round) / F.count("*"), F.lit(family) / F.sum("n")).alias("share"))
        chosen = (F.col("h") <= F.col("least")) | (F.col("h") < F.col("share") * (1 << 40))
        pivots = rest.join(left, "family").where(chosen).select("family", "node").checkpoint()
        if pivots.isEmpty():
            return links
        with_sets = pivots.join(sets.select("family", "node", F.col("codes").alias("codes")), ["family", "node"]).join(shape.select("family", "salts"), "family").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)))
        found = salted.groupBy("family", "salt").cogroup(with_sets.groupBy("family", "salt")).applyInPandas(compare, "u binary, v binary")
        links = links.union(found).checkpoint()
        asked = pivots.select("node") if asked is None else asked.union(pivots.select("node")).checkpoint()
        per_round, turn = per_round * 2, turn + 1


def near_duplicates(docs: DataFrame, percent: int = PERCENT, family: int = FAMILY) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept (doc_id = component_id).

    family: the most shingles that one task settles."""
    spark = docs.sparkSession
    bounded_batches(spark)
    trees = orders(percent)
    every = stored(spark, sketch(docs, trees), "sketch")
    nodes = every.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.first("keys").alias("keys"))
    nodes = stored(spark, nodes, "nodes")
    families = components(stored(spark, candidate_edges(nodes, trees).distinct(), "edges")).withColumnRenamed("root", "family")
    members = stored(spark, nodes.where("doc_id is not null").select("node", "doc_id", "n").join(families, "node"), "members")
    sizes = members.groupBy("family").agg(F.sum("n").alias("size"))
    large = sizes.where(F.col("size") > family).select("family").checkpoint()
    some = not large.isEmpty()
    wanted = members.select("node", "doc_id", "family")
    links = _settle_families(full_sets(docs, wanted.join(F.broadcast(large), "family", "left_anti") if some else wanted), percent)
    if some:
        links = links.union(_settle_large(full_sets(docs, wanted.join(large, "family", "left_semi")), percent, family))
    links = stored(spark, links.where("u <> v"), "links")
    roots = components(links)
    labelled = nodes.select("node", "doc_id").join(roots, "node")
    best = labelled.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = labelled.join(best, "root").select("node", "component")
    found = every.select("doc_id", "n_shingles", "node").join(nodes.select("node", F.col("doc_id").alias("own")), "node", "left").join(named, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "own", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The contract in SQL: shingles, links by a join on them, components by recursion.
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near duplicates (similarity 0.8 or more) stays, the one with the smallest doc_id."""
    gone = near_duplicates(docs, percent=80).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
