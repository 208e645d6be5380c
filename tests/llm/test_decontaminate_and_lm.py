import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from orpheon.llm import decontaminate, lm_scoring

SF = "/root/testdata/sf0.01"


def fewest_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def fold(text):
    return "".join(" " if c in "\t\n\r\x0b\x0c" else c.lower() if "A" <= c <= "Z" else c for c in text)


def edited(text, k, rng):
    chars = list(text)
    for _ in range(k):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("xyz")
        elif kind == 1:
            del chars[at]
        else:
            chars.insert(at, rng.choice("xyz"))
    return "".join(chars)


def test_matches_equal_brute_force(spark):
    rng = random.Random(3)
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    items = list(zip(items["item_id"], items["text"], strict=True))[:8] + [(900, "tiny one"), (901, None), (902, "")]
    filler = pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()[:20]
    docs = []
    for i in range(60):
        item = items[i % 8][1]
        budget = int(decontaminate.EDIT_RATE * len(item))
        inner = edited(item, rng.randrange(0, 2 * budget), rng)
        base = filler[i % 20][:300]
        docs.append((i, base + " " + inner.upper() * (i % 3 == 0) + inner * (i % 3 != 0) + base[::-1]))
    docs += [(100, None), (101, ""), (102, "TINY\nONE"), (103, items[0][1] + items[0][1]), (103, items[0][1] + items[0][1])]
    frame = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, matches string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 300):
        rows = {(r.doc.doc_id): r.matches for r in decontaminate.find_benchmark(frame, bench, block_bytes=block).collect()}
        for doc_id, text in docs:
            expected = set()
            for item_id, item in items:
                if item and text:
                    q = decontaminate.Q
                    e = max(0, min(int(decontaminate.EDIT_RATE * len(item)), (len(item) - q) // q)) if len(item) >= q else 0
                    if fewest_edits(fold(item).encode(), fold(text).encode()) <= e:
                        expected.add(item_id)
            assert {m.item_id for m in rows[doc_id]} == expected, doc_id
        assert [(m.start, m.end, m.edits) for m in rows[103]] == [(0, len(items[0][1]), 0), (len(items[0][1]), 2 * len(items[0][1]), 0)]
    assert decontaminate.find_benchmark(frame.limit(0), bench).collect() == []
    assert all(r.matches == [] for r in decontaminate.find_benchmark(frame, bench.limit(0)).collect())


def least_edits(item, text):
    """The same for long texts: whole rows of the table, the last one given."""
    t, steps = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(item, 1):
        step = np.r_[i, np.minimum(row[:-1] + (t != c), row[1:] + 1)]
        row = np.minimum.accumulate(step - steps) + steps
    return int(row.min())


def test_alignment_equals_the_whole_table():
    rng = random.Random(1)
    for _ in range(800):
        item = bytes(rng.choices(b"abc", k=rng.randrange(1, 14)))
        text = bytes(rng.choices(b"abc", k=rng.randrange(20)))
        budget = rng.randrange(4)
        got = decontaminate.align(np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8), budget)
        for end in range(len(text) + 1):
            expected = min(fewest_edits(item, text[a:end]) if a == end else whole_distance(item, text[a:end]) for a in range(end + 1))
            assert got[end] == min(expected, budget + 1)


def whole_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_whole_table_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    items, docs = (pq.read_table(f"{folder}/{name}.parquet").to_pydict() for name in ("benchmark", "documents"))
    q = decontaminate.Q
    rows = {r.doc_id: set(r.item_ids) for r in decontaminate.op3_decontamination(spark, folder).collect()}
    assert len(rows) == len(docs["doc_id"]) and any(rows.values())
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        raw = fold(text or "").encode()
        for item_id, item in zip(items["item_id"], items["text"], strict=True):
            sought = fold(item).encode()
            e = max(0, min(int(decontaminate.EDIT_RATE * len(sought)), (len(sought) - q) // q))
            if item_id in rows[doc_id]:
                assert least_edits(sought, raw) <= e
            elif len({raw[k : k + 4] for k in range(len(raw) - 3)} & {sought[k : k + 4] for k in range(len(sought) - 3)}) > len(sought) // 4:  # others share too few bytes in a row
                assert least_edits(sought, raw) > e


def test_repeats_of_a_shared_phrase_and_long_texts():
    rng = random.Random(4)
    phrase = "what is the meaning of this short phrase "
    tail = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    items = [(k, phrase + tail(160)) for k in range(100)]
    index = decontaminate.Index(items)

    def search(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return index.search(raw, np.array([0, len(raw)]))[0]

    assert search((phrase * 300)[:12_000]) == []
    near = items[7][1][:90] + "#" + items[7][1][91:]
    text = tail(5_000_000) + items[3][1] + tail(4_200_000) + items[3][1] + near + phrase * 9 + near
    first, second = 5_000_000, 5_000_000 + 201 + 4_200_000
    assert [(m["item_id"], m["start"], m["end"], m["edits"]) for m in search(text)] == [(3, first, first + 201, 0), (3, second, second + 201, 0), (7, second + 201, second + 402, 1), (7, len(text) - 201, len(text), 1)]
    assert [m["edits"] for m in search(items[5][1] + near[:150] + near)] == [0, 1]


def test_many_blocks_are_searched_in_turn(spark):
    docs = spark.createDataFrame([(k, f"some text with the {k:03} th benchmark item in it") for k in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, f"the {k:03} th benchmark item") for k in range(30)], "item_id long, text string")
    rows = decontaminate.find_benchmark(docs, bench, edit_rate=0.0, block_bytes=60, passes=4).collect()
    assert {r.doc.doc_id: [m.item_id for m in r.matches] for r in rows} == {k: [k] for k in range(30)}


def test_planted_benchmark_passages_are_found(spark):
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    docs = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    planted = {d: {i for i, t in zip(items["item_id"], items["text"], strict=True) if t in x} for d, x in zip(docs["doc_id"], docs["text"], strict=True)}
    for r in decontaminate.op3_decontamination(spark, SF).collect():
        assert planted[r.doc_id] <= set(r.item_ids)
        assert r.contaminated == bool(r.item_ids)


class Naive:
    """Context-tree weighting by recursion over one bit node of all contexts."""

    def __init__(self, texts, depth):
        self.counts, self.depth = Counter(), depth
        for t in texts:
            padded = bytes(depth) + t
            for i in range(depth, len(padded)):
                bits = f"{padded[i]:08b}"
                for d in range(depth + 1):
                    for k in range(8):
                        self.counts[padded[i - d : i], bits[:k], bits[k]] += 1
        self.kids = {}
        for ctx, _, _ in self.counts:
            if ctx:
                self.kids.setdefault(ctx[1:], set()).add(ctx)

    def block(self, ctx, node):
        a, b = self.counts[ctx, node, "0"], self.counts[ctx, node, "1"]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(self, ctx, node):
        own = self.block(ctx, node)
        if len(ctx) == self.depth:
            return own
        return math.log(0.5) + np.logaddexp(own, sum(self.weighted(x, node) for x in self.kids.get(ctx, ())))

    def one(self, history, node, d=0):
        ctx = history[self.depth - d :]
        a, b = self.counts[ctx, node, "0"], self.counts[ctx, node, "1"]
        own = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return own
        w = math.exp(math.log(0.5) + self.block(ctx, node) - self.weighted(ctx, node))
        return w * own + (1 - w) * self.one(history, node, d + 1)

    def score(self, text):
        padded, total = bytes(self.depth) + text, 0.0
        for i in range(self.depth, len(padded)):
            bits = f"{padded[i]:08b}"
            for k in range(8):
                p = self.one(padded[i - self.depth : i], bits[:k])
                total += math.log10(p if bits[k] == "1" else 1 - p)
        return total


@pytest.mark.parametrize("how", [{}, {"depth": 3}, {"depth": 6, "held": 3}])
def test_scores_equal_brute_force(spark, how):
    given = [(i, t) for i, t in enumerate(["abab", "ab ba AB", "", None, "b\tb\na", "zzz \u00e9", "abc abc abc", "qu", "a" * 40, "ab", "abc abd"])]
    given += [(3, "repeat"), (None, "null id")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in given], "doc_id long, text string, score double")
    train = [t or "" for i, t in given if i is None or i % 3 != 2]
    rows = lm_scoring.score_documents(docs, F.expr("coalesce(doc_id % 3 <> 2, true)"), **how).collect()
    lowered = [t.encode().lower() for t in train]
    counts = Counter(w for t in lowered for w in [*t.split(), b""])
    n, v = sum(counts.values()), len(counts)
    naive = Naive(lowered, how.get("depth", lm_scoring.DEPTH))
    assert len(rows) == len(given)
    by_key = sorted(((r.doc_id is None, r.doc_id, r.n_tokens), r) for r in rows)
    expected = sorted(((i is None, i, len((t or "").split()) + 1), t or "") for i, t in given)
    for (key, r), (other, text) in zip(by_key, expected, strict=True):
        assert key == other
        tokens = [*text.encode().lower().split(), b""]
        assert r.n_known == sum(counts[w] > 0 for w in tokens) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), abs=1e-9)
        assert r.score == pytest.approx(naive.score(text.encode().lower()), abs=1e-4)


def test_without_training_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    rows = lm_scoring.score_documents(docs, F.lit(False)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(2, 0, 0), (1, 0, 0)]
    assert rows[0].score == pytest.approx(-16 * math.log10(2)) and rows[1].score == 0 and rows[1].bits_per_byte is None
    assert lm_scoring.score_documents(docs.limit(0), F.lit(True)).collect() == []
    with pytest.raises(ValueError):
        lm_scoring.score_documents(docs, F.lit(True), depth=7)


def test_rare_words_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a a b w{i} w{i // 2}") for i in range(20)], "doc_id long, text string")
    every = F.lit(True)
    full = {r.doc_id: r for r in lm_scoring.score_documents(docs, every).collect()}
    monkeypatch.setattr(lm_scoring, "FREQUENT", 2)
    few = {r.doc_id: r for r in lm_scoring.score_documents(docs, every, held=0).collect()}
    for k, r in full.items():
        assert few[k].n_known == r.n_known and few[k].base_score == pytest.approx(r.base_score) and few[k].score == pytest.approx(r.score, abs=1e-4)


def test_probabilities_of_a_context_add_up_to_one():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 3000, dtype=np.uint8)
    codes, counts = np.unique(lm_scoring.gram_codes(data, np.array([0, 3000]), 4), return_counts=True)
    for context in (int(codes[50]) >> 8, int(codes[9]) >> 8, 0x61616100):
        asked = np.unique(np.concatenate([codes, (context << 8) + np.arange(256)]))
        learnt = np.zeros(len(asked))
        learnt[np.searchsorted(asked, codes)] = counts
        tree = lm_scoring.Subtrees(asked, learnt, 4)
        logs = lm_scoring.Top(*tree.above).finish(asked, tree.ones, 4)
        assert (10 ** logs[asked >> 8 == context]).sum() == pytest.approx(1, abs=1e-5)


def test_lookup_finds_what_it_holds_and_nothing_else():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 56, 5000))
    model = lm_scoring.Lookup(codes[::2], np.arange(len(codes[::2])) / 7)
    value, missing = model.get(codes)
    assert missing.tolist() == list(range(1, len(codes), 2)) and np.allclose(value[::2], np.arange(len(codes[::2])) / 7)
    assert lm_scoring.Lookup(codes[:0], np.zeros(0)).get(codes)[1].tolist() == list(range(len(codes)))


def test_deeper_contexts_learn_more(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held_out = F.expr("crc32(cast(doc_id as string)) % 7 = 2")
    cost = {d: lm_scoring.score_documents(docs, ~held_out, depth=d).where(held_out).selectExpr("-sum(score)").first()[0] for d in (3, 5)}
    assert cost[5] < cost[3]


def test_training_split_is_crc():
    assert zlib.crc32(b"5") % 7 in range(7)
