import random

import pyarrow.parquet as pq
import pytest

from orpheon.llm import line_dedup

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def near_words(rng, size=40):
    return bytes(rng.choice(b"abcd ") for _ in range(size))


def edit(line, k, rng):
    x = bytearray(line)
    for _ in range(k):
        at = rng.randrange(len(x))
        kind = rng.randrange(3)
        if kind == 0:
            x[at] = rng.choice(b"abcdz")
        elif kind == 1:
            del x[at]
        else:
            x.insert(at, rng.choice(b"abcdz"))
    return bytes(x)


@pytest.mark.parametrize("most", [0, 1, 2, 3, 5])
def test_banded_distance_equals_plain(most):
    rng = random.Random(most)
    for _ in range(1500):
        a = near_words(rng, rng.randrange(0, 60))
        b = edit(a, rng.randrange(0, most + 3), rng) if len(a) > 20 else near_words(rng, rng.randrange(0, 8))
        assert line_dedup.edit_distance(a, b, most) == min(distance(a, b), most + 1)


@pytest.mark.parametrize("most", [1, 2, 5])
def test_segments_meet_for_every_linked_pair(most):
    rng = random.Random(8)
    met = 0
    for _ in range(4000):
        a = near_words(rng, rng.randrange(8, 90))
        b = edit(a, rng.randrange(0, most + 1), rng)
        if distance(a, b) <= line_dedup.edits_of(min(len(a), len(b)), most) and min(len(a), len(b)) >= line_dedup.SHORT:
            met += 1
            keys = [{(s, x[p:q]) for s, p, q in line_dedup.plan_of(len(x), most)} for x in (a, b)]
            assert keys[0] & keys[1]
    assert met > 1000


def brute(docs, edits=2):
    places, node = {}, {}
    for doc_id, text in docs:
        for no, x in enumerate(line_dedup.lines_of((text or "").encode())):
            if x:
                node.setdefault(x, len(node))
                places.setdefault(x, []).append((doc_id, no))
    names = list(node)
    parent = {x: x for x in names}
    links = dict.fromkeys(names, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            most = min(edits, min(len(a), len(b)) // 12)
            if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    first = {}
    for x in names:
        first[find(x)] = min([first.get(find(x), (10**9, 0)), *places[x]])
    rows = {}
    for doc_id, text in docs:
        lines = [(no, x) for no, x in enumerate(line_dedup.lines_of((text or "").encode())) if x]
        rows[doc_id] = (len(lines), sum(first[find(x)] != (doc_id, no) for no, x in lines), sum(links[x] for _, x in lines), [first[find(x)][0] for _, x in lines])
    return rows


def corpus():
    rng = random.Random(11)
    base = [near_words(rng, rng.randrange(26, 70)) for _ in range(12)] + [near_words(rng, rng.randrange(9, 27)) for _ in range(4)]
    docs = [(0, None), (1, ""), (2, "\n \n\t"), (3, "No.\nNo.\nno. \nNo"), (4, "q" * 30000 + "\n" + "q" * 30001)]
    for i in range(10, 70):
        docs.append((i, "\n".join(edit(rng.choice(base), rng.randrange(0, 4), rng).decode() for _ in range(rng.randrange(1, 6)))))
    return docs


@pytest.mark.parametrize("crowd", [1000, 3])
@pytest.mark.parametrize("few", [256, 2])
def test_classes_equal_brute_force(spark, monkeypatch, crowd, few):
    monkeypatch.setattr(line_dedup, "FEW", few)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    monkeypatch.setattr(line_dedup, "bounded_batches", lambda spark: None)
    docs = corpus()
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, lines int")
    small = [(i, t) for i, t in docs if i != 4]
    got = {r.doc_id: (r.n_lines, r.n_repeats, r.n_links, r.line_class) for r in line_dedup.line_classes(frame, crowd=crowd).collect()}
    assert got.pop(4) == (2, 1, 2, [4, 4])
    assert got == brute(small)


def test_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(7, "same line of text, long enough"), (7, "same line of text, long enough"), (None, "same line of text, long enough")], "doc_id long, text string")
    rows = line_dedup.line_classes(frame).collect()
    assert sorted((r.doc_id is None, r.n_lines) for r in rows) == [(False, 1), (False, 1), (True, 1)]
    assert line_dedup.line_classes(frame.limit(0)).collect() == []


def test_stage_removes_boilerplate_and_keeps_documents(spark):
    rng = random.Random(3)
    own = lambda n: near_words(rng, n).decode().replace("d", rng.choice("efgh"))
    note = "subscribe to our newsletter now and then"
    copy = "\n".join(own(80) for _ in range(4))
    docs = [(i, f"{own(200)}\n{note}{'!' * (i % 2)}\n{own(150)}") for i in range(6)] + [(10, copy), (11, copy), (12, copy + "\nmore"), (13, f"{own(90)}\nagain and again and again\nagain and again and again"), (14, None), (15, "")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in line_dedup.line_stage(spark, frame, "").collect()}
    assert line_dedup.line_stage(spark, frame, "").columns == frame.columns and set(out) == {i for i, _ in docs}
    given = dict(docs)
    assert out[0].text == given[0]
    for i in range(1, 6):
        lines = given[i].split("\n")
        assert out[i].text == f"{lines[0]}\n{lines[2]}" and out[i].n_chars == len(out[i].text)
    for i in (10, 11, 12, 14, 15):
        assert out[i].text == given[i]
    assert out[13].text.count("again and again and again") == 1


def test_whole_table_equals_brute_force_on_a_small_scale(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    docs = [(i, x) for i, x in zip(t["doc_id"], t["text"], strict=True)]
    names = {x for _, t in docs for x in line_dedup.lines_of((t or "").encode()) if x}
    assert len(names) < 3000
    rows = {r.doc_id: r for r in line_dedup.op10_line_dedup(spark, SF).collect()}
    first = {}
    for doc_id, text in docs:
        for x in line_dedup.lines_of((text or "").encode()):
            if x:
                first.setdefault(x, doc_id)
    for doc_id, text in docs:  # equal lines at least share their class
        lines = [x for x in line_dedup.lines_of((text or "").encode()) if x]
        assert rows[doc_id].n_lines == len(lines)
        assert all(c <= first[x] for c, x in zip(rows[doc_id].line_class, lines, strict=True))
        if rows[doc_id].n_links == 0:
            assert rows[doc_id].line_class == [first[x] for x in lines]


def test_an_edit_moves_four_bits_at_most():
    rng = random.Random(6)
    for _ in range(3000):
        a = near_words(rng, rng.randrange(3, 50))
        k = rng.randrange(3)
        b = edit(a, k, rng)
        one, two = (int(x) for x in line_dedup.signatures([a, b]))
        assert ((one ^ two) & (1 << 60) - 1).bit_count() <= 4 * k and line_dedup.signatures([b])[0] == two
        assert two >> 60 == line_dedup.edits_of(len(b), 2)
    for edits in (0, 1, 2, 12):
        sets = line_dedup.sets_of(edits)
        assert len(sets) == 4 * edits + 1 and sets[0][0] == 0 and sets[-1][1] == 60 and all(a < b for a, b in sets) and all(x[1] == y[0] for x, y in zip(sets, sets[1:], strict=False))


def test_a_crowd_of_template_lines(spark):
    """2,000 lines that differ in a number: no key is held whole, and the links are those of the numbers."""
    rng = random.Random(9)
    numbers = [f"{rng.randrange(10**6):06}" for _ in range(2000)]
    docs = [(k, f"order {x} was received and will be handled as soon as we can") for k, x in enumerate(numbers)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    by_rest = {}
    for x in set(numbers):
        rests = {x} | {x[:a] + x[a + 1 :] for a in range(6)}
        for rest in rests | {r[:a] + r[a + 1 :] for r in rests for a in range(len(r))}:
            by_rest.setdefault(rest, []).append(x)
    links = dict.fromkeys(numbers, 0)
    for a, b in {tuple(sorted((x, y))) for group in by_rest.values() for x in group for y in group if x < y}:
        if distance(a.encode(), b.encode()) <= 2:
            links[a] += 1
            links[b] += 1
    got = {r.doc_id: r.n_links for r in line_dedup.line_classes(frame, crowd=150).collect()}
    assert got == {k: links[x] for k, x in enumerate(numbers)} and sum(got.values()) > 1000


def test_more_edits_of_longer_lines(spark):
    rng = random.Random(12)
    line = near_words(rng, 70).decode()
    changed = line[:10] + "ZZZZ" + line[14:]
    frame = spark.createDataFrame([(1, line), (2, changed)], "doc_id long, text string")
    assert [r.n_links for r in line_dedup.line_classes(frame).collect()] == [0, 0]
    assert [r.n_links for r in line_dedup.line_classes(frame, edits=4).collect()] == [1, 1]


def test_stage_removes_all_repeats_but_near_copies(spark):
    rng = random.Random(21)
    own = lambda n: near_words(rng, n).decode().replace("d", rng.choice("efgh")).replace(" ", "x")
    head, foot, passage = "home | news | sport | weather | login", "all rights reserved by the owners of it", [own(60), own(70)]
    docs = {i: "\n".join([head, own(150), foot]) for i in range(5)}  # two shared lines in many documents
    docs |= {10: f"{head}\n{own(20)}\n{foot}", 11: f"{head}\n{foot}"}  # short pages, mostly or all boilerplate
    docs |= {20: "\n".join([own(200), *passage]), 21: "\n".join([own(200), *passage])}  # lines that two documents share
    docs |= {30: "\n".join([head, own(90), own(80), foot])}
    docs |= {31: docs[30], 32: docs[30] + "\nmore", 33: docs[30] + "\n" + docs[20]}  # near copies, and two texts in one
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text.split("\n") for r in line_dedup.line_stage(spark, frame, "").collect()}
    lines = {i: t.split("\n") for i, t in docs.items()}
    assert out[0] == lines[0] and out[20] == lines[20]
    for i in (1, 2, 3, 4, 10):
        assert out[i] == [lines[i][1]]
    assert out[11] == [""] and out[33] == [""]
    assert out[21] == lines[21][:1]
    assert out[30] == out[31] == lines[30][1:3] and out[32] == [*lines[30][1:3], "more"]
