import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from orpheon.llm import suffix_dedup

SF = "/root/testdata/sf0.001"


def brute(docs, length):
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(x[k : k + length] for _, x in raw for k in range(len(x) - length + 1))
    rows = []
    for i, x in raw:
        cover = np.zeros(len(x) + 1, np.int64)
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                cover[k] += 1
                cover[k + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(x) else 0
        left = bytes(np.frombuffer(x, np.uint8)[~gone])
        rows.append((i, len(x), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(rows, key=str)


def got(frame, **how):
    rows = suffix_dedup.remove_repeats(frame, **how).collect()
    assert all(sum(s.b - s.a for s in r.spans) == r.n_removed and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=str)


def test_runs_equal_sorted_windows():
    rng = random.Random(2)
    for size, letters, length in [(50, b"ab", 9), (4000, b"abc", 12), (300, b"a", 40), (3000, b"abcdefgh\xff", 10)]:
        text = np.frombuffer(bytes(rng.choice(letters) for _ in range(size)) + b"\0", np.uint8)
        text = np.concatenate([text, text[: size // 2], text[:0]])
        order, run = suffix_dedup.long_runs(text, length)
        raw = text.tobytes() * (length // len(text) + 2)
        windows = [raw[k : k + length] for k in order]
        assert windows == sorted(windows)
        assert [a == b for a, b in zip(windows, windows[1:], strict=False)] == (run[1:] == run[:-1]).tolist()


def docs():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(8))
    base = " ".join(word() for _ in range(120))
    passage = "".join(rng.choice("xyz") for _ in range(230))
    found = [(i, base[: rng.randrange(len(base))] + word() * 3 + base[rng.randrange(len(base)) :]) for i in range(25)]
    found += [(30 + i, "".join(rng.choice("pqrstuv") for _ in range(300)) + passage + "".join(rng.choice("pqrstuv") for _ in range(rng.randrange(300)))) for i in range(60)]
    found += [(100, None), (101, ""), (102, "short"), (103, passage[:199]), (104, "ab" * 700), (105, "q" * 3000), (106, base), (107, base), (107, base)]
    found += [(None, passage + "!"), (108, passage[:215] + "\0\0" + passage[:15])]
    return found


@pytest.mark.parametrize("how", [{}, {"block": 3000}, {"block": 3000, "crowd": 3000}, {"block": 3000, "crowd": 300}])
def test_equal_to_brute_force(spark, how):
    given = docs()
    frame = spark.createDataFrame([(i, t, "x") for i, t in given], "doc_id long, text string, hash string")
    assert got(frame, **how) == brute(given, 200)


def test_whole_table_equals_brute_force(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    rows = suffix_dedup.op1_suffix_dedup(spark, SF).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=str) == brute(list(zip(t["doc_id"], t["text"], strict=True)), 200)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_anchors_do_not_depend_on_what_is_scanned_with_a_text():
    rng = np.random.default_rng(7)
    text, before = rng.integers(97, 100, 900, dtype=np.uint8), rng.integers(97, 100, 70_000, dtype=np.uint8)
    alone = suffix_dedup.contexts(text, np.array([0, 900]), 200)
    late = suffix_dedup.contexts(np.concatenate([before, text]), np.array([0, 70_000, 70_900]), 200)
    mine = late[0] == 1
    assert len(alone[0]) > 3 and all((a == b[mine]).all() for a, b in zip(alone[1:], late[1:], strict=True))


def test_levels_choose_other_anchors_and_lose_no_window():
    text = np.random.default_rng(8).integers(97, 123, 5000, dtype=np.uint8)
    found = [suffix_dedup.contexts(text, np.array([0, 5000]), 200, level) for level in range(3)]
    for _, _, first, last in found:
        assert np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)]).tolist() == list(range(4801))
    assert len({tuple(x[1].tolist()) for x in found}) == 3


def test_a_very_long_text(spark):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage = noise(300)
    frame = spark.createDataFrame([(1, noise(1_500_000) + passage + noise(1_000_000) + passage + noise(9)), (2, noise(50))], "doc_id long, text string")
    assert [(r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(frame).orderBy("doc_id").collect()] == [(1, 600, 2), (2, 0, 0)]
