import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from orpheon.llm import near_dedup

SF = "/root/testdata/sf0.01"


def shingles(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(docs, percent=85):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    for k, (i, s) in enumerate(sets):
        for m in {m for x in s for m in where[x] if m < k}:
            j, t = sets[m]
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def test_whole_table_equals_brute_force(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    expected = brute(list(zip(t["doc_id"], t["text"], strict=True)))
    rows = near_dedup.op8_near_duplicates(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and len({r.component_id for r in rows}) < len(rows)


def family_docs():
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "A b"), (4, "a  B"), (5, "x " * 9000), (6, "b a")]
    for i in range(10, 90):
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(50)}"
        docs.append((i, " ".join(words)))
    docs += [(100 + i, " ".join(f"z{rng.randrange(5)}" for _ in range(8))) for i in range(30)]
    return docs


@pytest.mark.parametrize("bounds", [{}, {"family": 600}])
def test_hot_families(spark, bounds):
    docs = family_docs()
    frame = spark.createDataFrame([(i, t, True) for i, t in docs], "doc_id long, text string, kept boolean")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame, **bounds).collect()}
    assert got == brute(docs)


def test_repeated_rows_null_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f"), (9, "other words here")], "doc_id long, text string")
    rows = near_dedup.near_duplicates(frame).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (7, 7, True), (7, 7, True), (9, 7, False), (9, 9, True)]
    assert near_dedup.near_duplicates(frame.limit(0)).collect() == []


def test_walk_links_equal_prefixes_and_sparse_regions():
    rows = np.array([[0, 1, 2, 3, 4], [0, 1, 2, 3, 4], [0, 1, 2, 3, 5], [0, 1, 2, 4, 4], [1, 1, 2, 4, 4]], np.uint32)
    assert near_dedup.walk(rows, False, False)[0].tolist() == [1, 2]  # the third by three values in a run of three
    assert near_dedup.walk(rows, True, False)[0].tolist() == [1]
    crowd = np.array([[0, 1, 2, 3, k] for k in range(near_dedup.SPARSE + 1)], np.uint32)
    assert near_dedup.walk(crowd, False, False)[0].tolist() == [] and len(near_dedup.walk(crowd[1:], False, False)[0]) == near_dedup.SPARSE - 1


@pytest.mark.parametrize("parts", ["1", "37"])
def test_candidates_do_not_depend_on_ranges(spark, parts):
    """All nodes that share four values in an order are joined, and those of sparse regions that share three."""
    rng = random.Random(6)
    keys = [bytes(rng.randrange(2) for _ in range(2 * 4 * near_dedup.DEPTH)) for _ in range(300)]
    keys = [b"".join(bytes([a, 0, 0, 0]) for a in k[:8]) for k in keys]
    nodes = [(bytes([k >> 8, k & 255]) * 8, key) for k, key in enumerate(keys)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    edges = {(bytes(r.u), bytes(r.v)) for r in near_dedup.candidate_edges(spark.createDataFrame(nodes, "node binary, keys binary"), 2).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    got = near_brute_components({n for n, _ in nodes}, edges)
    wanted = set()
    for tree in range(2):
        by4, by3 = {}, {}
        for n, key in nodes:
            by4.setdefault(key[16 * tree : 16 * tree + 16], []).append(n)
            by3.setdefault(key[16 * tree : 16 * tree + 12], []).append(n)
        wanted |= {(a, b) for g in by4.values() for a, b in zip(g, g[1:], strict=False)}
        wanted |= {(a, b) for g in by3.values() if len(g) <= near_dedup.SPARSE for a, b in zip(g, g[1:], strict=False)}
    assert got == near_brute_components({n for n, _ in nodes}, wanted)


def near_brute_components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), set()).add(n)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("percent, words", [(85, 66), (80, 49)])
def test_pairs_that_just_make_it_are_found(spark, percent, words):
    """1,500 pairs with one word changed, which have 85 (80) percent of their shingles in common; a miss is expected in 1 of 67 runs."""
    rng = random.Random(percent)
    docs = []
    for k in range(1500):
        text = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        docs.append((2 * k, " ".join(text)))
        text[words // 2] = "other"
        docs.append((2 * k + 1, " ".join(text)))
    a, b = shingles(docs[0][1]), shingles(docs[1][1])
    assert percent <= 100 * len(a & b) / len(a | b) < percent + 1.5
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert near_dedup.near_duplicates(frame, percent=percent).where("component_id = doc_id - doc_id % 2").count() == 3000


def test_rare_shingles_find_the_same_links():
    rng = random.Random(2)
    boilerplate = list(range(80))
    sets = [sorted({*rng.sample(boilerplate, 70), *(1000 + rng.randrange(300) for _ in range(rng.randrange(20, 60)))}) for _ in range(150)]
    sets += [sorted({*s[:-1], 7777}) for s in sets[:40]]
    index = near_dedup.FamilyIndex([np.array(s, np.uint64).tobytes() for s in sets])
    for k, s in enumerate(sets):
        expected = [j for j, t in enumerate(sets) if 100 * len({*s} & {*t}) >= 85 * len({*s} | {*t})]
        assert index.linked(k, 85).tolist() == expected
